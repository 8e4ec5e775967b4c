"""Operator 9 against brute force in plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tessera.llm import line_dedup, queries

LAST = float("inf")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked(a, b, rate=32, most=4, floor=20):
    short = min(len(a), len(b))
    edits = min(most, max(1, short // rate))
    return short >= floor and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits


def grouped(lines, near):
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lines = sorted(lines)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    out = defaultdict(set)
    for x in lines:
        out[find(x)].add(x)
    return {x: frozenset(g) for g in out.values() for x in g}


def mutated(rng, text, most):
    x = list(text)
    for _ in range(rng.randint(0, min(most, len(x) - 1))):
        k = rng.randrange(len(x))
        rng.choice([lambda: x.insert(k, rng.choice("zéq ")), lambda: x.pop(k), lambda: x.__setitem__(k, rng.choice("yñ"))])()
    return "".join(x)


def near_lines(seed=4, n=120, lengths=(24, 33, 60, 63, 64, 66, 95, 97, 127, 129, 140, 300), most=6):
    rng = random.Random(seed)
    base = [fixtures.words(rng, 80)[:k] for k in lengths]
    lines = base + [mutated(rng, rng.choice(base), most) for _ in range(n)]
    rng.shuffle(lines)
    return [x for x in lines if "\n" not in x]


def spanned(spark, lines, **parameters):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    links, texts = line_dedup.edit_links(docs, **parameters)
    name = {r["node"]: r["line"] for r in texts.collect()}
    return {frozenset((name[r["na"]], name[r["nb"]])) for r in links.collect()}


def joined(lines, pairs):
    return grouped(lines, lambda a, b: frozenset((a, b)) in pairs)


@pytest.mark.parametrize("most", [1, 2, 4, 6])
def test_edit_distance_equals_brute_force(spark, most):
    rng = random.Random(most)
    pairs = [("", ""), ("", "ab"), ("a", "a"), ("😀b", "b😀"), ("x" * 700, "x" * 350 + "y" + "x" * 349)]
    for _ in range(600):
        a = "".join(rng.choice("abñ") for _ in range(rng.randint(0, 40)))
        pairs.append(tuple(sorted((a, mutated(rng, a, 8) if a else "b"), key=len)))
    found = spark.createDataFrame(pairs, "x string, y string").select(line_dedup.edit_distance(F.col("x"), F.col("y"), most).alias("d")).collect()
    for (a, b), r in zip(pairs, found):
        d = distance(a, b)
        assert r["d"] == d if d <= most else r["d"] > most, (a, b)


@pytest.mark.parametrize("rate, most, floor", [(32, 4, 20), (10_000, 1, 20), (8, 3, 4), (40, 6, 2)])
def test_links_equal_brute_force(spark, rate, most, floor):
    lines = sorted(set(near_lines()) | {mutated(random.Random(k), "short ones", 3) for k in range(10)})
    got = spanned(spark, lines, rate=rate, most=most, min_chars=floor)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b, rate, most, floor)}
    assert got == want and want


def dense_lines():
    """Crowds of several kinds: typing errors at some places, numbers, one beginning or end with unlike rests."""
    rng = random.Random(6)
    base = fixtures.words(rng, 30)[:70]
    lines = {base} | {mutated(rng, base, 3) for _ in range(60)}
    lines |= {base[:k] + c + base[k + 1 :] for k in (3, 35, 69) for c in "abcdefgh"}
    lines |= {f"This is the footer of page {k}" for k in (*range(30), *range(990, 1000))}
    lines |= {f"This is the footer of page {k} of the book" for k in range(20)}
    lines |= {"One beginning that many lines of the corpus have: " + fixtures.words(rng, 5) for _ in range(40)}
    lines |= {fixtures.words(rng, 5) + " and one end that many lines of the corpus have" for _ in range(40)}
    lines |= {base[:40] + fixtures.words(rng, 2)[:6] + base[40:] for _ in range(30)}
    return sorted(lines)


@pytest.mark.parametrize("crowd, rate, most", [(8, 64, 2), (12, 24, 3), (8, 10_000, 1), (8, 32, 4)])
def test_crowds_are_split_without_losing_a_class(spark, monkeypatch, crowd, rate, most):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    lines = dense_lines()
    got = spanned(spark, lines, rate=rate, most=most)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b, rate, most)}
    assert got < want
    assert joined(lines, got) == joined(lines, want)


@pytest.mark.parametrize("paired", [0, 24, 2000])
def test_crowds_pair_by_sketches_or_are_cut(spark, monkeypatch, paired):
    """Classes are the same whether a crowd's lines are compared by their sketches or cut into windows."""
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    monkeypatch.setattr(line_dedup, "PAIRED", paired)
    lines = dense_lines()
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b, 32, 4)}
    got = spanned(spark, lines, rate=32, most=4)
    assert got < want
    assert joined(lines, got) == joined(lines, want)


def test_sketches_of_linked_lines_differ_in_two_bits_an_edit(spark):
    rng = random.Random(11)
    pairs = []
    for k in range(300):
        x = "".join(rng.choice("abcñ😀 ") for _ in range(rng.randint(1, 60)))
        pairs.append((x, mutated(rng, x, k % 5)))
    sides = [line_dedup.sketch(F.col(c), list("abñ😀 ")) for c in "xy"]
    found = spark.createDataFrame(pairs, "x string, y string").select(F.bit_count(sides[0].bitwiseXOR(sides[1])).alias("bits"), sides[0].alias("s")).collect()
    assert all(r["bits"] <= 2 * distance(x, y) - abs(len(x) - len(y)) for (x, y), r in zip(pairs, found))
    gray = [0, 1, 3, 2]
    assert all(r["s"] == sum(gray[x.count(c) % 4] << 2 * k for k, c in enumerate("abñ😀 ")) for (x, _), r in zip(pairs, found))


def test_a_crowd_of_unlinked_copies_makes_no_windows(spark, monkeypatch):
    """Near copies beyond four edits are told apart by their sketches: nothing is cut, and few pairs are verified."""
    rng = random.Random(12)
    base = fixtures.words(rng, 80).split(" ")
    lines = []
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(20, 80), 6):
            copy[at] = fixtures.words(rng, 1)
        lines.append(" ".join(copy))
    lines = sorted({*lines, *(mutated(rng, x, 3) for x in lines[:10])})
    sizes, plain = [], line_dedup.materialize

    def counted(df, name):
        out = plain(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    got = spanned(spark, lines)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b, line_dedup.RATE, line_dedup.MOST)}
    assert joined(lines, got) == joined(lines, want) and want
    assert not [x for x in sizes if x[0] == "cut"]
    assert sum(n for name, n in sizes if name == "pairs") < len(lines) * 4


def test_copies_of_one_line_meet_through_it(spark, monkeypatch):
    """Copies four edits from one line and eight from each other are one class by it, and make few pairs besides."""
    rng = random.Random(13)
    base = fixtures.words(rng, 80)[:400]
    places = rng.sample(range(400), 80)
    lines = sorted({base} | {base[:k] + "".join(rng.choice("abcdefghilmnorstu") for _ in range(4)) + base[k:] for k in places})
    sizes, plain = [], line_dedup.materialize

    def counted(df, name):
        out = plain(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    got = spanned(spark, lines)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b)}
    assert joined(lines, got) == joined(lines, want) and len(set(joined(lines, want).values())) == 1
    assert sum(n for name, n in sizes if name == "pairs") < 3 * len(lines)


def test_lines_of_very_few_letters(spark, monkeypatch):
    """What is left of a crowd's lines after all cuts is tried, lines of more than one length included."""
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    lines = sorted({a + b + c for a in ("", "x", "y") for b in ("x", "yy", "z") for c in ("", "xz", "zzz")} - {""})
    got = spanned(spark, lines, rate=3, most=2, min_chars=2)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if linked(a, b, 3, 2, 2)}
    assert got <= want
    assert joined(lines, got) == joined(lines, want)


def expected(data):
    """Per doc_id: cleaned text, removed, removed near, links, class labels; texts of rows that share an id are concatenated in no order."""
    lines = {x for _, t, *_ in data for x in (t or "").split("\n") if x}
    group = grouped(lines, linked)
    order = sorted(data, key=lambda r: (LAST if r[0] is None else r[0]))
    first, times = {}, Counter()
    for i, t, *_ in order:
        for place, x in enumerate((t or "").split("\n")):
            if x:
                times[group[x]] += 1
                first.setdefault(group[x], (i, place, x))
    out = {}
    for i, t, *_ in order:
        kept, near, links, labels, gone = [], 0, 0, set(), 0
        for place, x in enumerate((t or "").split("\n")):
            g = group.get(x)
            if g is None or times[g] == 1:
                kept.append(x)
                continue
            links += len(g) - 1
            labels.add(f"{'' if first[g][0] is None else first[g][0]}:{first[g][1]}")
            if first[g][:2] == (i, place):
                kept.append(x)
                continue
            gone += 1
        out[i] = (hashlib.sha256("\n".join(kept).encode()).hexdigest(), gone, links, ",".join(sorted(labels)))
    return out


def test_report_rows(spark, tmp_path):
    lines = near_lines()
    data = [(100 + i // 4, "\n".join(lines[i : i + 4]) + "\nshort", None, None, None) for i in range(0, len(lines), 4)]
    data += [(200, lines[0] + "\n" + lines[0] + "\n\n" + lines[1], None, None, None), (None, lines[2], None, None, None), (300, None, None, None, None), (301, "", None, None, None)]
    folder = fixtures.write(spark, tmp_path, data)
    got = {r["doc_id"]: r for r in queries.op9_line_dedup(spark, folder).collect()}
    want = expected(data)
    assert {i: (r["cleaned_sha256"], r["n_removed"], r["n_links"], r["classes"]) for i, r in got.items()} == want
    assert sum(r["n_removed_near"] for r in got.values()) > 10
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("row", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("line", F.lit("x"))
    for table in (docs, docs.drop("n_chars")):
        cleaned = line_dedup.deduplicated(table)
        assert cleaned.columns == table.columns
        assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in cleaned.collect()} == {i: w[0] for i, w in want.items()}


def test_awkward_rows_are_kept(spark, tmp_path):
    data = fixtures.rows()
    got = queries.op9_line_dedup(spark, fixtures.write(spark, tmp_path, data)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    assert queries.op9_line_dedup(spark, fixtures.write(spark, tmp_path / "none", [])).count() == 0
    assert queries.op9_line_classes(spark, fixtures.write(spark, tmp_path / "none2", [])).count() == 0


def test_links_mean_one_thing_at_any_size(spark, tmp_path):
    lines = [f"This is the footer of page {k}" for k in range(200)] + [f"{a}{b} is the running head of this book" for a in "abcdefghij" for b in "abc"]
    data = [(k, x, None, None, None) for k, x in enumerate(lines)]
    got = {r["doc_id"]: r["n_links"] for r in queries.op9_line_dedup(spark, fixtures.write(spark, tmp_path, data)).collect()}
    group = grouped(lines, linked)
    assert got == {k: len(group[x]) - 1 for k, x in enumerate(lines)}


def test_line_classes_list_every_class_of_a_document(spark, tmp_path):
    common, passage = "A common line of many documents.", "A long passage that two documents share."
    texts = {3: common, 500: passage + "\nOnly here, in this one document.\nLes.", 600: f"{common}\n{passage[:-1]}!\nLes.", None: "A common line of many documents"}
    data = [(k, t, None, None, None) for k, t in texts.items()]
    rows = queries.op9_line_classes(spark, fixtures.write(spark, tmp_path, data)).collect()
    got = {(r["doc_id"], r["place"]): (r["kept_doc"], r["kept_place"], r["n_links"], r["stays"]) for r in rows}
    assert got == {
        (3, 0): (3, 0, 1, True),
        (600, 0): (3, 0, 1, False),
        (None, 0): (3, 0, 1, False),
        (500, 0): (500, 0, 1, True),
        (600, 1): (500, 0, 1, False),
        (500, 2): (500, 2, 0, True),
        (600, 2): (500, 2, 0, False),
    }
    assert len({r["class_id"] for r in rows}) == 3 and len(rows) == 7


def test_rows_that_share_an_id(spark):
    rows = [(1, "the same line\na first end"), (1, "the same line\na second end"), (1, "the same line\na first end"), (2, "the same line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in line_dedup.deduplicated(docs).collect())
    kept = [t for i, t in got.elements() if i == 1 and "same" in t]
    assert got[(2, "")] == 1 and len(set(kept)) == 1 and sum(got.values()) == 4
