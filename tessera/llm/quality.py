"""Operator 2, quality rules: line-first cleaning, in SQL functions only.

Each line of a text is judged by itself.  A line with words fails if it

* is noise by punctuation: more than 3 symbols in 10 words and 3 at least, or
  runs of exclamation or question marks after more than 1 word in 5 and 3 at
  least;
* is navigation: separators between blanks, 3 or more, or 1 in up to 5 words;
* is boilerplate: up to 20 words with a phrase of the list below;
* is a fragment: up to 2 words and no closing punctuation.

Failing lines are removed.  A document is kept if it passes the base rules of
the contract and the removed lines held at most ``MAX_LOST`` of its word
characters.  Everything is one row's own expression: no shuffle, no state.

A null or empty text has no words and so fails the base.  Lines without words
never fail and stay where they are.  Rows repeat as they come; other columns
are kept as they are.  Windows of three words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words_of

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent
MAX_LOST = 0.3
#: Up to so many repeated windows a linear search is used.
FEW = 32

SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?]{2,}"
SEPARATORS = r"\s(?:\||»|>|·|/|•)\s"
CLOSING = r"""[.!?…:;,)\]"'»”’。！？][\s]*$"""
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "read more",
    "sign in",
    "sign up",
    "log in",
    "subscribe to our newsletter",
    "share this",
    "follow us",
    "skip to content",
    "back to top",
)
_BOILERPLATE = r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s+") for p in BOILERPLATE) + r")\b"


def line_fails(line: Column, n: Column, symbols: Column) -> Column:
    """Does a line of ``n`` words with so many symbols fail a rule?"""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    few = lambda words, pattern: (n <= words) & F.rlike(line, F.lit(pattern))
    shouts = let(count(SHOUTS), lambda c: (c >= 3) & (c * 5 > n))
    noise = ((symbols >= 3) & (symbols * 10 > n * 3)) | shouts
    navigation = let(count(SEPARATORS), lambda c: (c >= 3) | ((c >= 1) & (n <= 5)))
    fragment = (n <= 2) & ~F.rlike(line, F.lit(CLOSING))
    return (n > 0) & (noise | navigation | few(20, _BOILERPLATE) | fragment)


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""
    n = F.size(w)

    def of(tri: Column) -> Column:
        def positions(repeated: Column) -> Column:
            search = F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.array_contains(repeated, F.get(tri, i)))

            def runs(pairs: Column) -> Column:
                like = lambda p, k: F.coalesce(p["h"] == F.get(pairs, k)["h"], F.lit(False))
                both = F.filter(pairs, lambda p, j: like(p, j - 1) | like(p, j + 1))
                return F.sort_array(F.transform(both, lambda p: p["i"]))

            sort = let(F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), runs)
            return F.when(F.size(repeated) == 0, F.array().cast("array<int>")).when(F.size(repeated) <= FEW, search).otherwise(sort)

        repeated = let(F.sort_array(tri), lambda s: F.array_distinct(F.filter(s, lambda h, j: (j > 0) & (h == F.get(s, j - 1)))))
        start = F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["words"] + F.least(F.lit(3), p - a["last"])).alias("words"), p.alias("last"))
        return F.aggregate(let(repeated, positions), start, step, lambda a: a["words"])

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, of))


def _judged(text: Column) -> Column:
    def of_lines(lines: Column) -> Column:
        def of_words(words: Column) -> Column:
            symbols = F.transform(lines, lambda x: F.regexp_count(x, F.lit(SYMBOLS)))

            def of_symbols(s: Column) -> Column:
                fails = F.transform(lines, lambda x, i: line_fails(x, F.size(F.get(words, i)), F.get(s, i)))
                full = F.filter(lines, lambda x, i: F.size(F.get(words, i)) > 0)
                chars = lambda w: F.char_length(F.array_join(w, ""))
                flat = F.flatten(words)
                return let(
                    fails,
                    lambda f: F.struct(
                        F.size(flat).cast("long").alias("n_words"),
                        chars(flat).cast("long").alias("word_chars"),
                        F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_symbols"),
                        let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                        let(flat, repeated_words).cast("long").alias("n_repeat_words"),
                        chars(F.flatten(F.filter(words, lambda _, i: F.get(f, i)))).cast("long").alias("lost_chars"),
                        F.filter(lines, lambda _, i: ~F.get(f, i)).alias("kept_lines"),
                    ),
                )

            return let(symbols, of_symbols)

        return let(F.transform(lines, words_of), of_words)

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of_lines)


def assess(docs: DataFrame, name: str = "_quality") -> DataFrame:
    """Add a column: the statistics, ``lost_chars``, ``kept_lines``, ``base_failed`` and ``kept``."""
    # generated, not projected: a filter on the verdict would else be pushed below and judge the text again for each field
    judged = docs.select("*", F.explode(F.array(_judged(F.col("text")))).alias(name))
    q = F.col(name)
    base = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"])
    kept = ~base & (q["lost_chars"] <= MAX_LOST * q["word_chars"])
    return judged.withColumn(name, q.withField("base_failed", base).withField("kept", kept))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failing lines; the columns stay, n_chars (if there) follows the text.

    Other columns may have any name; the table may be empty.
    """
    name = "_quality"
    while name in docs.columns:
        name += "_"
    text = F.array_join(F.col(name)["kept_lines"], "\n")
    found = assess(docs, name).where(F.col(name)["kept"]).withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select([F.col(f"`{c}`") for c in docs.columns])


def digests(assessed: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return assessed.select("doc_id", *[F.col(f"_quality.{n}") for n in names])
