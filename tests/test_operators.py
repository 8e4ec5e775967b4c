"""Operators on small written tables and their laws."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import timeline
from tessera.model import ROW_SCHEMA
from tessera.operators import dedupe, graph, reading, records, rules, scene, sequence, xref
from tessera.query import Explore, GraphTables, Refused, count_of, kind_of, window_of
from tessera.sources import sections


@pytest.fixture(scope="module")
def events(spark):
    rows = [("e1", "conquest", "gilgal", -1406, -1406, 1), ("e2", "conquest", "jericho", -1406, -1406, 2), ("e3", "conquest", "jericho", -1405, -1405, 3), ("e4", "conquest", "ai", -1405, -1405, 4), ("e5", "fathers", "hebron", -2000, -2000, 1)]
    return spark.createDataFrame(rows, "event string, narrative string, place string, from_year int, to_year int, seq int")


def test_scene(events):
    lit = {r["place"]: (r["n_events"], r["brightness"]) for r in scene.lit(events, -1406, -1405).collect()}
    assert lit == {"gilgal": (1, 1), "jericho": (2, 2), "ai": (1, 1)}
    assert [tuple(r) for r in scene.quiet(events, -1406, -1405).collect()] == [("hebron", 1)]
    arrows = scene.arrows(events, -1406, -1405, ["seq"])
    assert sorted((r["order"], r["from_place"], r["to_place"]) for r in arrows.collect()) == [(1, "gilgal", "jericho"), (3, "jericho", "ai")]
    assert [tuple(r) for r in scene.legend(events, arrows, -1406, -1405).collect()] == [("conquest", 4)]
    with pytest.raises(timeline.BadWindow):
        scene.lit(events, 0, 5)


def test_lit_and_quiet_partition_the_places(spark):
    rng = random.Random(1)
    rows = [(k, k % 7, k % 23, a := rng.choice([y for y in range(-9, 9) if y]), a + (1 if a == -1 else 0) + 0) for k in range(300)]
    rows = [(e, n, p, a, b or 1) for e, n, p, a, b in rows]
    df = spark.createDataFrame(rows, "event int, narrative int, place int, from_year int, to_year int")
    for window in ((-9, -5), (-2, 1), (3, 3)):
        lit = {r["place"] for r in scene.lit(df, *window).collect()}
        quiet = {r["place"] for r in scene.quiet(df, *window).collect()}
        assert not lit & quiet and lit | quiet == {r[2] for r in rows}
        want = {r[2] for r in rows if r[3] <= window[1] and window[0] <= r[4]}
        assert lit == want


def test_display_names(spark):
    places = spark.createDataFrame([("a", "Aphek 2"), ("b", "Bethel"), ("c", "Cana 3"), ("d", "Dan")], "place string, name string")
    names = spark.createDataFrame([("a", "Old", -10, -5), ("a", "New", -4, 5), ("b", "Luz", -30, -20), ("d", "Laish", -2, -1), ("d", "Later", 2, 3)], "place string, name string, from_year int, to_year int")
    aliases = spark.createDataFrame([("c", "Kana"), ("b", "House")], "place string, alias string")
    got = {r["place"]: r["display_name"] for r in scene.display_names(places, names, aliases, -6, 4).collect()}
    assert got == {"a": "New", "b": "House", "c": "Kana", "d": "Laish"}
    got = {r["place"]: r["display_name"] for r in scene.display_names(places, names, aliases, 20, 30).collect()}
    assert got == {"a": "Aphek", "b": "House", "c": "Kana", "d": "Dan"}


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, 1, "Contains", "C:1", "P:1", None, None, "s"), (1, 2, "Contains", "C:1", "P:2", None, None, "s"), (1, 3, "Contains", "C:1", "P:3", None, None, "t"),
        (2, 1, "Cites", "P:1", "P:2", 5, None, "x"), (2, 2, "Cites", "P:1", "P:2", 7, None, "y"), (2, 3, "Cites", "P:1", "P:3", 1, None, "x"),
        (3, 1, "Spouses", "P:2", "P:1", None, None, "z"),
    ]
    return graph.lower(spark.createDataFrame(data, ROW_SCHEMA))


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("C:1", "Container", "All"), ("P:1", "Person", "Ann"), ("P:2", "Person", "Bob")], "id string, kind string, label string")


def test_index_and_summary(rows, nodes):
    index = graph.bi_index(rows)
    got = {(r["position"], r["rel"], r["dir"]): r["n_edges"] for r in graph.edge_summary(index).collect()}
    assert got == {
        ("C:1", "Contains", "forward"): 3, ("P:1", "Contains", "inverse"): 1, ("P:2", "Contains", "inverse"): 1, ("P:3", "Contains", "inverse"): 1,
        ("P:1", "Cites", "forward"): 2, ("P:2", "Cites", "inverse"): 1, ("P:3", "Cites", "inverse"): 1, ("P:1", "Spouses", "both"): 1, ("P:2", "Spouses", "both"): 1,
    }
    assert graph.inverse_gaps(index).count() == 0
    assert [(r["rel"], r["side"], r["position"], r["n_rows"]) for r in graph.dangling(rows, nodes).orderBy("rel").collect()] == [("Cites", "object", "P:3", 1), ("Contains", "object", "P:3", 1)]
    assert graph.positions(nodes, index).count() == 4
    behind = {(r["n_rows"], r["first_ord"]) for r in graph.rows_behind(rows).collect()}
    assert (2, 1) in behind
    assert {(r["rel"], r["provenances"]) for r in graph.provenance_sets(rows, "rel").collect()} == {("Contains", "s,t"), ("Cites", "x,y"), ("Spouses", "z")}


def test_pages_chain_to_the_whole(rows):
    index = graph.bi_index(rows)
    whole = [r["other"] for r in graph.edge_page_at(index, "C:1", "Contains", "forward").collect()]
    assert whole == ["P:1", "P:2", "P:3"]
    for limit in (1, 2):
        cursor, seen = None, []
        while True:
            page = graph.edge_page_at(index, "C:1", "Contains", "forward", cursor, limit).collect()
            seen += [r["other"] for r in page if not r["next"]]
            more = [r for r in page if r["next"]]
            if not more:
                break
            cursor = (more[0]["family"], more[0]["row_ord"])
        assert seen == whole
    first = graph.edge_page(index, 2).where("position = 'P:1' and rel = 'Cites'").orderBy("place").collect()
    assert [r["other"] for r in first] == ["P:2", "P:3"]


def test_explore_and_tables(spark, rows, nodes):
    g = GraphTables(spark, nodes, rows)
    trail = g.explore("C:1").follow("contains").follow("cites")
    assert sorted(r["position"] for r in trail.here.collect()) == ["P:2", "P:3"]
    assert sorted(r["position"] for r in trail.back().here.collect()) == ["P:1", "P:2", "P:3"]
    assert {r["label"]: r["n_edges"] for r in g.explore("P:1").links().collect()} == {"member-of": 1, "cites": 2, "spouse-of": 1}
    assert isinstance(trail.both(trail.start()), Explore)
    card = g.node("P:1").head()
    assert card["label"] == "Ann" and [e["label"] for e in card["edges"]] == ["member-of", "cites", "spouse-of"]
    got = g.elements(["P:2", "P:9", "P:1"]).collect()
    assert [(r["id"], r["missing"]) for r in got] == [("P:2", False), ("P:9", True), ("P:1", False)]
    page = g.edges("P:1", "cites", limit="1").collect()
    assert [(r["other"], r["other_label"], r["next"]) for r in page] == [("P:2", "Bob", False), ("P:3", None, True)]
    assert [r["id"] for r in g.find("b").collect()] == ["P:2"]
    assert {(r["what"], r["name"]): r["n"] for r in g.kinds().collect()}[("edge", "Cites")] == 2
    for call in (lambda: g.node("P:9"), lambda: g.edges("P:1", "nope"), lambda: g.text(0), lambda: g.find(" "), lambda: window_of(0, 4), lambda: window_of("x", 4)):
        with pytest.raises(Refused):
            call()


def test_arguments():
    assert count_of(["3", "7"], 20, 200) == 7
    assert count_of("many", 20, 200) == 20 and count_of("999", 20, 200) == 200 and count_of("-2", 20, 200) == 1 and count_of(None, 20, 200) == 20
    assert window_of("-5", ["1", "30"]) == (-5, 30)
    assert kind_of("cited-by") == ("Cites", "inverse") and kind_of("spouse-of") == ("Spouses", "both")
    assert reading.clamp("x") == 1 and reading.clamp(900) == 500


def test_closure_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (7, 8), (8, 7), (9, 9)], "parent int, child int")
    got = {tuple(r) for r in graph.closure(edges.where("parent < 7"), 8).collect()}
    assert got == {(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 3, 1), (2, 4, 2), (1, 4, 2)}
    assert sorted(r["node"] for r in graph.cycles(edges).collect()) == [7, 8, 9]
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(k,) for k in range(60)], "node int")
    found = graph.components(spark.createDataFrame(links, "a int, b int"), nodes)
    assert {r["node"]: r["component"] for r in found.collect()} == dict(enumerate(root))


def test_reading(spark):
    units = spark.createDataFrame([(c, v, f"t{c}.{v}") for c in (1, 2, 5) for v in range(1, 5)], "chapter int, verse int, text string")
    ordered = reading.spine(units).cache()
    assert [r["ord"] for r in ordered.orderBy("chapter", "verse").collect()] == list(range(12))
    at = lambda *a, **k: [r["ord"] for r in reading.window(ordered, *a, **k).orderBy("ord").collect()]
    assert at(3, 4) == [3, 4, 5, 6] and at(10, 9) == [10, 11] and at(5, 3, backward=True) == [3, 4, 5] and at(1, 4, backward=True) == [0, 1, 2, 3] and at(3, 0) == []
    assert at(0, 5) + at(5, 7) == at(0, 12)
    assert reading.next_place(3, 4, 12) == 7 and reading.next_place(10, 2, 12) is None and reading.next_place(5, 3, 12, True) == 2 and reading.next_place(1, 4, 12, True) is None
    spans = {r["chapter"]: (r["first_ord"], r["n_units"]) for r in reading.chapter_spans(ordered).collect()}
    assert spans == {1: (0, 4), 2: (4, 4), 5: (8, 4)}


def test_runs(spark):
    rows = [("a", 1, 1), ("a", 1, 2), ("a", 1, 2), ("a", 1, 4), ("a", 1, 5), ("a", 2, 1), ("a", 3, 2), ("b", 1, 5)]
    verses = spark.createDataFrame(rows, "owner string, chapter int, verse int")
    ends = spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "chapter int, last_verse int")
    got = sorted(tuple(r) for r in reading.runs(verses, ["owner"], ends=ends).collect())
    assert got == [("a", 1, 1, 1, 2, 2), ("a", 1, 4, 2, 1, 3), ("a", 3, 2, 3, 2, 1), ("b", 1, 5, 1, 5, 1)]
    plain = reading.runs(verses, ["owner"])
    assert sorted(tuple(r)[1:5] for r in reading.passages(plain).collect()) == [(1, 1, 1, 2), (1, 4, 1, 5)]
    refs = records.reference_runs(spark.createDataFrame([("x", 1, v) for v in (2, 3, 4, 6)] + [("x", 3, 1)], "k string, chapter int, verse int"), ["k"])
    assert refs.head()["reference"] == "1.2-4, 6, 3.1"
    ranges = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 10, 12), ("a", 14, 14), ("a", 4, 5)], "k string, first int, last int")
    assert sorted(tuple(r) for r in reading.merged_ranges(ranges, ["k"]).collect()) == [("a", 1, 12), ("a", 14, 14)]


def test_headings(spark):
    rows = [("u", True, 9, 1, 1, 1, "cont"), ("u", False, 1, 2, 5, 1, "late"), ("u", False, 1, 2, 3, 1, "b"), ("u", False, 1, 2, 3, 1, "a"), ("u", False, 0, 9, 1, 1, "low"), ("v", True, 1, 1, 1, 1, "only")]
    df = spark.createDataFrame(rows, "unit string, is_continuation boolean, layer int, kind_rank int, year int, seq int, heading string")
    assert {r["unit"]: r["heading"] for r in reading.heading_winners(df, ["unit"]).collect()} == {"u": "a", "v": "only"}


def test_xrefs(spark):
    refs = spark.createDataFrame([("a", "x", 2, 1), ("a", "y", 5, 2), ("a", "x", 3, 3), ("a", "z", 9, 4), ("a", "w", 5, 5)], "s string, t string, votes int, seen int")
    previews = spark.createDataFrame([("x", "X"), ("y", "Y"), ("w", "W")], "t string, preview string")
    got = [(r["t"], r["votes"], r["rank"]) for r in xref.top_targets(refs, "s", "t", "seen", previews, 2).orderBy("rank").collect()]
    assert got == [("x", 5, 1), ("y", 5, 2)]
    seen = xref.first_seen(refs, ["t"], ["s"], ["seen"])
    assert [r["t"] for r in seen.orderBy("place").collect()] == ["x", "y", "z", "w"]


def test_sequences(spark):
    rows = spark.createDataFrame([("c", k, v) for k, v in enumerate("abbac")], "chain string, seq int, item string")
    assert [(r["prior"], r["next"]) for r in sequence.steps(rows, ["chain"], "item", ["seq"]).collect()] == [("a", "b"), ("b", "b"), ("b", "a"), ("a", "c")]
    assert [r["item"] for r in sequence.without_repeats(rows, ["chain"], "item", ["seq"]).orderBy("seq").collect()] == ["a", "b", "a", "c"]
    assert [r["id"] for r in sequence.suffixed(rows, "item", ["seq"]).orderBy("seq").collect()] == ["a", "b", "b-2", "a-2", "c"]
    got = sequence.timeline_order(spark.createDataFrame([(1, -3, 2), (2, 5, 1), (3, -3, 1)], "e int, y int, k int"), "y", ["k"])
    assert {r["e"]: r["seq"] for r in got.collect()} == {3: 0, 1: 1, 2: 2}


def test_set_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    sets = {k: set(rng.choices("abcdefghijkl", k=rng.randint(1, 8))) for k in range(60)}
    members = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "i int, e string")
    for threshold in (0.5, 0.7, 1.0):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
        assert {tuple(r)[:3] for r in dedupe.set_pairs(members, "i", "e", threshold).collect()} == want


@pytest.mark.parametrize("bits, listed", [(63, 20_000), (63, 3), (4, 3)])
def test_equal_sets_are_compared_once(spark, monkeypatch, bits, listed):
    """The different sets alone meet; pairs of their items are made of those at the threshold."""
    monkeypatch.setattr(dedupe, "BIT_ELEMENTS", bits)
    monkeypatch.setattr(dedupe, "LISTED", listed)
    rng, compared, plain = random.Random(10), [], dedupe.set_classes
    base = [frozenset(rng.choices("abcdefghijkl", k=rng.randint(1, 8))) for _ in range(9)]
    sets = {k: base[k % 9] for k in range(90)}
    members = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s] + [(None, "a")], "i int, e string")

    def counted(whole):
        out = plain(whole)
        compared.append(out[0].count())
        return out

    monkeypatch.setattr(dedupe, "set_classes", counted)
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5)
    assert sorted(tuple(r)[:3] for r in dedupe.set_pairs(members, "i", "e", 0.5).collect()) == want
    assert compared == [len(set(base))]


@pytest.mark.parametrize("leaf, listed", [(4_000, 20_000), (5, 2)])
def test_different_bit_sets_equal_brute_force(spark, monkeypatch, leaf, listed):
    """Sets of one element to nearly all, most of them different, some with copies; starts are followed to their end."""
    monkeypatch.setattr(dedupe, "LEAF", leaf)
    monkeypatch.setattr(dedupe, "STEP", 100 * leaf)
    monkeypatch.setattr(dedupe, "LISTED", listed)
    rng = random.Random(12)
    sets = {k: frozenset(rng.sample(range(35), rng.choice([1, 1, 2, 2, 3, 5, 8, 9, 10, 12, 16, 30]))) for k in range(300)}
    sets |= {300 + k: sets[k % 40] for k in range(100)}
    members = spark.createDataFrame([(str(k), e) for k, s in sets.items() for e in s], "i string, e int")
    for threshold in (0.4, 0.5, 0.75):
        want = sorted((*sorted((str(a), str(b))), n := len(sets[a] & sets[b]), n / len(sets[a] | sets[b])) for a in sets for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold)
        assert sorted(map(tuple, dedupe.set_pairs(members, "i", "e", threshold).collect())) == want


def test_different_bit_sets_do_not_all_meet(spark):
    """Sets over few elements, where each element is in many, meet by several common ones, and no pair is shuffled."""
    rng = random.Random(14)
    masks = np.array(sorted({sum(1 << e for e in rng.sample(range(35), 9)) for _ in range(3_000)}), dtype=np.uint64)
    both, one = dedupe.least_common(0.5)
    compared = found = 0
    for f in range(35):
        for e in range(f):
            key = np.uint64(1 << e | 1 << f)
            own = masks[(masks & key == key) & (np.bitwise_count(masks & np.uint64((2 << f) - 1)) <= 9 - one[9] + 2)]
            compared += sum(len(rows) ** 2 // 2 for rows, *_ in dedupe._starts(own, one, int(key), f, 2, 200))
            found += sum(int((x != y).sum()) for x, y, _ in dedupe._met(own, both, one, int(key), 200, 50_000))
    assert found == sum(int((np.bitwise_count(masks[k] & masks[:k]) >= 6).sum()) for k in range(len(masks)))
    assert compared < len(masks) ** 2 // 2, compared
    members = spark.createDataFrame([(k, e) for k in range(40) for e in rng.sample(range(35), 9)], "i int, e int")
    plan = dedupe.set_pairs(members, "i", "e", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]


def test_rules(spark):
    eras = spark.createDataFrame([("a", -4004, -1), ("b", 1, 50), ("c", 52, 60), ("d", 60, 99)], "era string, from_year int, to_year int")
    assert {r["era"]: r["problem"] for r in rules.era_gaps(eras, *timeline.UNDATED).collect()} == {"c": "gap", "d": "overlap"}
    assert rules.era_gaps(spark.createDataFrame([("a", -4004, -1), ("b", 1, 100)], eras.schema), *timeline.UNDATED).count() == 0
    ranges = spark.createDataFrame([("p", 1, 1, 9), ("p", 2, 3, 4), ("p", 3, 9, 12), ("p", 4, 13, 14), ("q", 5, 1, 2)], "g string, k int, first int, last int")
    assert sorted(r["k"] for r in rules.overlaps(ranges, "g", "k", "first", "last").collect()) == [2, 3]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted((r["x"], r["side"]) for r in rules.same_tables(a, b).collect()) == [(1, "left"), (3, "right")]


def test_merges_and_tiers(spark):
    merges = spark.createDataFrame([("b", "a")], "absorbed string, survivor string")
    got = dedupe.repoint(spark.createDataFrame([("a",), ("b",), ("c",)], "p string"), "p", merges)
    assert sorted(r["p"] for r in got.collect()) == ["a", "a", "c"]
    known = spark.createDataFrame([("k", "1"), ("m", "1"), ("m", "2")], "key string, v string")
    wide = spark.createDataFrame([("t", "9")], "kind string, v string")
    rows = spark.createDataFrame([("k", "x"), ("m", "t"), ("n", "x")], "key string, kind string")
    assert {r["key"]: (r["v"], r["tier"]) for r in dedupe.tiered(rows, [("key", known), ("kind", wide)], "v").collect()} == {"k": ("1", 1), "m": ("9", 2), "n": (None, 0)}


def test_records(spark, rows, nodes):
    from tessera.model import edge_kinds

    labels = {r["label"] for r in records.edge_labels(rows, nodes, edge_kinds(spark)).collect()}
    assert "Ann · cites · Bob" in labels and "Ann · cites · P:3" in labels
    parents = spark.createDataFrame([("p", "a", "natural"), ("p", "b", "legal"), ("p", "c", "adoptive"), ("q", "a", "natural")], "parent string, child string, parentage string")
    assert {tuple(r) for r in records.siblings(parents).collect()} == {("a", "b"), ("b", "a")}
    units = spark.createDataFrame([(0, "In the"), (1, "beginning.")], "ord int, text string")
    comments = spark.createDataFrame([(0, 1, 0, "note")], "first int, last int, seq int, text string")
    view = records.interleaved(units, comments).orderBy("ord", "seq").collect()
    assert [r["text"] for r in view] == ["In the", "note", "beginning.", "note"]
    assert " ".join(r["text"] for r in view if r["kind"] == "text") == "In the beginning."
    canon = spark.createDataFrame([(1, "A b."), (2, "C d"), (3, "E"), (4, "F")], "unit int, text string")
    parts = spark.createDataFrame([(1, 0, "A"), (1, 1, "b."), (2, 0, "c"), (2, 1, "D!"), (3, 0, "X")], "unit int, ord int, text string")
    assert {r["unit"]: r["tier"] for r in records.conservation(canon, parts).collect()} == {1: "exact", 2: "case", 3: "mismatch", 4: "uncovered"}


def test_sections(spark, nodes):
    a = {("core", "nodes"): nodes}
    b = {("core", "nodes"): nodes.repartition(3).orderBy(F.desc("id"))}
    one, two = sections.section_hashes(a).collect(), sections.section_hashes(b).collect()
    assert one == two and one[0]["n_rows"] == 3
    other = sections.section_hashes({("core", "nodes"): nodes.withColumn("label", F.upper("label"))})
    assert {r["section"]: r["status"] for r in sections.verify(sections.section_hashes(a), other).collect()} == {"core": "mismatch"}
    assert sections.root_hash(sections.section_hashes(a)).head() != sections.root_hash(other).head()
    files = "path string, hash string, bytes long, link boolean"
    old = spark.createDataFrame([("a", "1", 9, False), ("b", "2", 9, False), ("c", "3", 9, False), ("d", "4", 9, False), ("e", "5", 9, False)], files)
    new = spark.createDataFrame([("a", "1", 9, False), ("b", "x", 5, False), ("c", "y", 9, False), ("e", "5", 9, True), ("f", "6", 1, False)], files)
    assert {r["path"]: r["problem"] for r in sections.drift(old, new).collect()} == {"b": "Truncated", "c": "Changed", "d": "Missing", "e": "LinkAdded", "f": "Extra"}
