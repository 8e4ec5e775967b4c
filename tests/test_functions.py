"""Functions on written cases and, where there are laws, on generated ones."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import model
from tessera.functions import geo, refs, text, timeline


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("first", "last", "label"),
    [(-1447, -1447, "1447 BC"), (30, 30, "AD 30"), (-1450, -1400, "1450 – 1400 BC"), (-5, 30, "5 BC – AD 30"), (30, 33, "AD 30 – 33"), (-1, 1, "1 BC – AD 1"), (33, 33, "AD 33")],
)
def test_range_labels(spark, first, last, label):
    assert one(spark, timeline.range_label(F.lit(first), F.lit(last))) == label
    assert one(spark, timeline.claim_label(F.lit(first), F.lit(last), F.lit("note"))) == f"c. {label}"
    assert one(spark, timeline.claim_label(F.lit(first), F.lit(last), F.lit(None))) == label


def test_years_skip_zero(spark):
    years = [y for y in range(-5, 6) if y]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    got = df.select("y", timeline.next_year(F.col("y")).alias("n"), timeline.index_year(timeline.year_index(F.col("y"))).alias("back"), timeline.add_years(F.col("y"), F.lit(2)).alias("two")).collect()
    assert [r["n"] for r in got] == [*years[1:], 6]
    assert [r["back"] for r in got] == years
    assert [r["two"] for r in got] == [*years[2:], 6, 7]


def test_midpoints_floor_to_the_earlier_year(spark):
    cases = [(-4, -1, -3), (-3, -1, -2), (-1, 1, -1), (1, 2, 1), (1, 3, 2), (-2, 1, -1), (-4004, 100, -1953)]
    for first, last, middle in cases:
        assert one(spark, timeline.midpoint(F.lit(first), F.lit(last))) == middle, (first, last)


def test_existence(spark):
    null = F.lit(None).cast("int")
    first, last = timeline.existence(F.lit(-100), null, F.lit(-200), F.lit(50))
    assert one(spark, F.struct(first.alias("a"), last.alias("b"))) == (-200, None)
    assert one(spark, timeline.gated(F.lit(10), null, F.lit(1), F.lit(9)))
    assert not one(spark, timeline.gated(F.lit(10), null, F.lit(1), F.lit(10)))
    assert not one(spark, timeline.gated(null, null, F.lit(1), F.lit(2)))
    assert one(spark, timeline.gated(null, F.lit(-5), F.lit(-4), F.lit(2)))


def test_parse_year(spark):
    for given_, want in (("-4003", -4004), ("0", -1), ("33-04-01", 33), ("1446 BC", -1446), (" ", None), ("soon", None), ("30", 30)):
        assert one(spark, timeline.parse_year(F.lit(given_))) == want, given_


def test_bad_windows():
    for window in ((0, 5), (5, 0), (3, 2)):
        with pytest.raises(timeline.BadWindow):
            timeline.check_window(*window)
    assert timeline.check_window(-4004, 100) == timeline.UNDATED


def test_refs(spark):
    cases = {
        "GEN": ("book", 0, None, None, None),
        "jhn.3": ("chapter", 42, 3, None, None),
        "JHN.3.16": ("verse", 42, 3, 16, 16),
        "REV.22.1-5": ("passage", 65, 22, 1, 5),
        "REV.22.5-5": (None,) * 5,
        "GEN.0": (None,) * 5,
        "ABC.1": (None,) * 5,
        "GEN.1.2.3": (None,) * 5,
        "": (None,) * 5,
        "GEN.70000": (None,) * 5,
    }
    df = spark.createDataFrame([(r,) for r in cases], "ref string")
    assert {r["ref"]: tuple(r)[1:] for r in refs.parse_ref(df, "ref").collect()} == cases
    assert refs.resolve_book("1 samuel") == refs.resolve_book("1Sam") == refs.BOOK_INDEX["1SA"]
    assert [r["testament"] for r in refs.books(spark).where("code in ('MAL', 'MAT')").orderBy("book").collect()] == ["OT", "NT"]
    assert len(refs.BOOKS) == 66


def test_citations():
    found = [c[:4] for c in text.citations("See Gen. 1:2-4, 1 John 2, 3ff. and Ps 119:5; not Gen 3:9-2, nor Genx 1:1.")]
    assert found == [(0, 1, 2, 4), (61, 2, 3, 3), (18, 119, 5, 5)]
    t = "é 1 Cor. 13:4"
    (_, _, _, _, start, end) = text.citations(t)[0]
    assert t[start:end] == "1 Cor. 13:4"


def test_name_spans():
    names = [("ai", "place", "Ai"), ("aij", "place", "Aijalon"), ("jo", "person", "Joshua"), ("j2", "place", "Joshua")]
    assert text.name_spans("Joshua went from Ai to Aijalon, said Aij.", names) == [("j2", "place", 0, 6), ("ai", "place", 17, 19), ("aij", "place", 23, 30)]
    assert text.name_spans("ai AI", names) == []


def test_tokens(spark):
    t = "God’s well-beloved – 2nd été- 'x' a--b"
    df = text.token_spans(spark.createDataFrame([(1, t), (2, None)], "k int, text string")).orderBy("k").collect()
    cut = [t[s["start"] : s["end"]] for s in df[0]["tokens"]]
    assert cut == ["God’s", "well-beloved", "2nd", "été", "x", "a", "b"]
    assert df[1]["tokens"] == []
    assert one(spark, text.tokens(F.lit(t))) == cut


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab’-é 1'.", max_size=30))
def test_token_spans_are_ordered_and_apart(t):
    spans = [(m.start(), m.end()) for m in text._TOKEN.finditer(t)]
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert all(t[a].isalnum() and t[b - 1].isalnum() for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(t) if c.isalnum())


def test_date_clauses(spark):
    got = one(spark, text.date_clauses(F.lit("In about 1446 B.C. and 30 A.D., or A. D. 33; B.C. 5 A.D. and Anno Mundi 7, but 4B.C. no")))
    assert [(r["calendar"], r["year"], r["approx"]) for r in got] == [("BC", 1446, True), ("AD", 30, False), ("AD", 33, False), ("BC", 5, False), ("AD", 5, False), ("AM", 7, False)]


def test_titles(spark):
    assert sorted(one(spark, text.title_words(F.lit("The Battle of Ai, and the battle's end!")))) == ["ai", "battle", "end", "s"]
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(a, F.array().cast("array<string>"))) == 0.0


def test_texts(spark):
    assert one(spark, text.slug(F.lit("  Beth-el (East) 2 "))) == "beth-el-east-2"
    assert one(spark, text.display_label(F.lit("attested-in"))) == "Attested in"
    assert one(spark, text.strip_number(F.lit("Aphek 2"))) == "Aphek"
    assert one(spark, text.strip_html(F.lit("<p>a &amp; b</p><script>x<y</script>\n c&lt;"))) == "a & b c<"
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")))
    assert one(spark, text.bracketed(F.lit("éabcdef"), spans)) == "[é]ab[cd]ef"
    found = one(spark, text.aligned_spans(F.lit("He said, Come. he said, Go."), F.array(F.lit("Come."), F.lit("HE SAID,"), F.lit("Come."))))
    assert [(r["start"], r["end"], r["how"]) for r in found] == [(9, 14, "exact"), (15, 23, "case"), (-1, -1, "missing")]
    assert text.longest_blocks("a b c d e".split(), "a b x d e".split()) == [(0, 0, 5)]
    assert text.longest_blocks("a b c".split(), "x y".split()) == []


def test_geometry(spark):
    corner = lambda lat, lon: F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    square = F.array(*(corner(*p) for p in ((0, 0), (0, 4), (4, 4), (4, 0), (0, 0))))
    bow = F.array(*(corner(*p) for p in ((0, 0), (4, 4), (0, 4), (4, 0), (0, 0))))
    assert one(spark, geo.ring_is_simple(square)) and not one(spark, geo.ring_is_simple(bow))
    assert one(spark, geo.in_ring(F.lit(2.0), F.lit(2.0), square)) and not one(spark, geo.in_ring(F.lit(5.0), F.lit(2.0), square))
    assert one(spark, geo.haversine_km(F.lit(31.78), F.lit(35.23), F.lit(31.78), F.lit(35.23))) == 0
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(3.141592653589793 * geo.EARTH_KM)
    assert one(spark, geo.in_box(F.lit(31.0), F.lit(35.0))) and not one(spark, geo.in_box(F.lit(60.0), F.lit(35.0)))
    assert geo.palette_slots({"b": 3, "a": 19, "c": 3}) == {"a": 3, "b": 4, "c": 5}


def test_ring_morph_ends_at_its_rings():
    import pandas as pd

    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    frame = pd.DataFrame({"id": [1, 2], "ring_a": [square, square], "ring_b": [square[::-1], square[::-1]], "share": [0.0, 0.5]})
    (out,) = geo.morph_rings(iter([frame]))
    for ring in out["ring"]:
        assert len(ring) == 128
        assert ring[0] == pytest.approx([0, 0], abs=0.01)


def test_edge_kinds(spark):
    kinds = model.edge_kinds(spark).collect()
    assert len(kinds) == 2 * 22 + 7
    labels = [k["label"] for k in kinds]
    assert len(set(labels)) == len(labels)
    assert all(model.dual_label(model.dual_label(x)) == x for x in labels)
    assert model.dual_label("contains") == "member-of" and model.dual_label("spouse-of") == "spouse-of"
    with pytest.raises(ValueError, match="bad_kind"):
        model.dual_label("nothing")
    both = one(spark, F.struct(model.edge_id(F.lit("Spouses"), F.lit("a"), F.lit("b")).alias("x"), model.edge_id(F.lit("Spouses"), F.lit("b"), F.lit("a")).alias("y")))
    assert both["x"] == both["y"]
    ways = one(spark, F.struct(model.edge_id(F.lit("Cites"), F.lit("a"), F.lit("b")).alias("x"), model.edge_id(F.lit("Cites"), F.lit("b"), F.lit("a")).alias("y")))
    assert ways["x"] != ways["y"]
