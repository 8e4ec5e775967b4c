"""References to books, chapters, verses and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, short name and name of each book, in reading order.
BOOKS = tuple(
    tuple(x.split("/"))
    for x in (
        "GEN/Gen/Genesis EXO/Exod/Exodus LEV/Lev/Leviticus NUM/Num/Numbers DEU/Deut/Deuteronomy JOS/Josh/Joshua JDG/Judg/Judges RUT/Ruth/Ruth "
        "1SA/1Sam/1_Samuel 2SA/2Sam/2_Samuel 1KI/1Kgs/1_Kings 2KI/2Kgs/2_Kings 1CH/1Chr/1_Chronicles 2CH/2Chr/2_Chronicles EZR/Ezra/Ezra "
        "NEH/Neh/Nehemiah EST/Esth/Esther JOB/Job/Job PSA/Ps/Psalms PRO/Prov/Proverbs ECC/Eccl/Ecclesiastes SNG/Song/Song_of_Solomon "
        "ISA/Isa/Isaiah JER/Jer/Jeremiah LAM/Lam/Lamentations EZK/Ezek/Ezekiel DAN/Dan/Daniel HOS/Hos/Hosea JOL/Joel/Joel AMO/Amos/Amos "
        "OBA/Obad/Obadiah JON/Jonah/Jonah MIC/Mic/Micah NAM/Nah/Nahum HAB/Hab/Habakkuk ZEP/Zeph/Zephaniah HAG/Hag/Haggai ZEC/Zech/Zechariah "
        "MAL/Mal/Malachi MAT/Matt/Matthew MRK/Mark/Mark LUK/Luke/Luke JHN/John/John ACT/Acts/Acts ROM/Rom/Romans 1CO/1Cor/1_Corinthians "
        "2CO/2Cor/2_Corinthians GAL/Gal/Galatians EPH/Eph/Ephesians PHP/Phil/Philippians COL/Col/Colossians 1TH/1Thess/1_Thessalonians "
        "2TH/2Thess/2_Thessalonians 1TI/1Tim/1_Timothy 2TI/2Tim/2_Timothy TIT/Titus/Titus PHM/Phlm/Philemon HEB/Heb/Hebrews JAS/Jas/James "
        "1PE/1Pet/1_Peter 2PE/2Pet/2_Peter 1JN/1John/1_John 2JN/2John/2_John 3JN/3John/3_John JUD/Jude/Jude REV/Rev/Revelation"
    ).split()
)
BOOK_INDEX = {code: i for i, (code, _, _) in enumerate(BOOKS)}
FIRST_NEW = BOOK_INDEX["MAT"]

# Abbreviations that citations use besides the names.
_ABBREVIATIONS = (
    "GEN=Gen EXO=Exod,Exo LEV=Lev NUM=Num DEU=Deut,Deu JOS=Josh JDG=Judg 1SA=1_Sam 2SA=2_Sam 1KI=1_Kings,1_Kgs 2KI=2_Kings,2_Kgs "
    "1CH=1_Chron,1_Chr 2CH=2_Chron,2_Chr NEH=Neh EST=Esth PSA=Ps,Pss,Psalm PRO=Prov ECC=Eccl ISA=Isa JER=Jer LAM=Lam EZK=Ezek,Eze DAN=Dan "
    "HOS=Hos OBA=Obad MIC=Mic NAM=Nah HAB=Hab ZEP=Zeph HAG=Hag ZEC=Zech MAL=Mal MAT=Matt,Mat MRK=Mk LUK=Lk ROM=Rom 1CO=1_Cor 2CO=2_Cor "
    "GAL=Gal EPH=Eph PHP=Php COL=Col 1TH=1_Thess,1_Thes 2TH=2_Thess,2_Thes 1TI=1_Tim 2TI=2_Tim TIT=Tit PHM=Philem HEB=Heb JAS=Jas 1PE=1_Pet "
    "2PE=2_Pet 1JN=1_John 2JN=2_John 3JN=3_John JUD=Jude REV=Rev"
)
#: Names by which a citation may call a book, with the book's number.
CITED_NAMES = {name.replace("_", " "): i for i, (_, _, name) in enumerate(BOOKS)} | {
    name.replace("_", " "): BOOK_INDEX[code] for code, names in (x.split("=") for x in _ABBREVIATIONS.split()) for name in names.split(",")
}

REF = r"^([0-9A-Za-z]{3})(?:\.(\d{1,5})(?:\.(\d{1,5})(?:-(\d{1,5}))?)?)?$"


class BadRef(ValueError):
    """A reference that doesn't parse."""


def books(spark: SparkSession) -> DataFrame:
    """``book, code, osis, name, testament``."""
    rows = [(i, c, o, n.replace("_", " "), "OT" if i < FIRST_NEW else "NT") for i, (c, o, n) in enumerate(BOOKS)]
    return spark.createDataFrame(rows, "book int, code string, osis string, name string, testament string")


def resolve_book(text: str) -> int:
    """A book's number from its code, short name or name, without regard to case and punctuation."""
    plain = lambda s: "".join(c for c in s if c.isascii() and c.isalnum()).lower()
    for i, names in enumerate(BOOKS):
        if plain(text) in map(plain, names):
            return i
    raise BadRef(f"bad_ref: {text}")


def parse_ref(df: DataFrame, ref: str) -> DataFrame:
    """Add ``form, book, chapter, first, last``: of a book, chapter, verse or passage; a bad reference has form null.

    Numbers run from 1 to 65535 and a passage needs a first verse below its last.
    """
    part = lambda k: F.regexp_extract(ref, REF, k)
    number = lambda k: part(k).try_cast("int")
    codes = F.create_map(*[F.lit(x) for code, i in BOOK_INDEX.items() for x in (code, i)])
    book = F.element_at(codes, F.upper(part(1)))
    fine = lambda n: n.between(1, 65535)
    form = (
        F.when(book.isNull(), F.lit(None))
        .when(part(2) == "", "book")
        .when(~fine(number(2)), F.lit(None))
        .when(part(3) == "", "chapter")
        .when(~fine(number(3)), F.lit(None))
        .when(part(4) == "", "verse")
        .when(fine(number(4)) & (number(3) < number(4)), "passage")
    )
    some = lambda c: F.when(form.isNotNull(), c)
    return df.withColumns({"form": form, "book": some(book), "chapter": some(number(2)), "first": some(number(3)), "last": some(F.coalesce(number(4), number(3)))})


def ref_contains(form: Column, chapter: Column, first: Column, last: Column, v_chapter: Column, v_verse: Column) -> Column:
    """Does a reference contain a verse of its own book?"""
    return (
        F.when(form == "book", F.lit(True))
        .when(form == "chapter", chapter == v_chapter)
        .otherwise((chapter == v_chapter) & v_verse.between(first, last))
    )


def within(first: Column, last: Column, span_first: Column, span_last: Column) -> Column:
    """A subset: both ends inside."""
    return (first >= span_first) & (last <= span_last)


def expand(df: DataFrame, first: str, last: str, out: str = "verse") -> DataFrame:
    """A row for each verse of a range."""
    return df.withColumn(out, F.explode(F.sequence(first, last)))
