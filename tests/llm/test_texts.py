"""Operators 1, 2, 6, 7 and 10 against brute force in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import fixtures
from tessera.llm import fingerprint, license_scan, quality, queries, sharding, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(1 << 63)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 1

def shingles(text):
    words = WORD.findall(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprint_rows(spark, tmp_path):
    data = [r for r in fixtures.rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())  # a next document needs different ids to be told
    got = {r["doc_id"]: r for r in queries.op1_fingerprint(spark, fixtures.write(spark, tmp_path, data)).collect()}
    order = sorted(data, key=lambda r: -r[0])
    assert len(got) == len(order)
    prints = {}
    for row, after in zip(order, order[1:] + order[:1]):
        text, following = row[1] or "", after[1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[row[0]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == sha(edited)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b, c = shingles(text), shingles(edited), shingles(following)
        assert len(r["fingerprint"]) == 12 * min(128, len(a))
        exact = len(a) < 128 and len(b) < 128
        assert r["near_edited"] == pytest.approx(jaccard(a, b), abs=1e-12 if exact else 0.25)
        exact = len(a) < 128 and len(c) < 128
        assert r["near_next"] == pytest.approx(jaccard(a, c), abs=1e-12 if exact else 0.25)


def test_fingerprint_keeps_awkward_rows(spark, tmp_path):
    data = fixtures.rows()
    got = queries.op1_fingerprint(spark, fixtures.write(spark, tmp_path, data)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    assert queries.op1_fingerprint(spark, fixtures.write(spark, tmp_path / "none", [])).count() == 0
    one = queries.op1_fingerprint(spark, fixtures.write(spark, tmp_path / "one", [(5, "a b c d e f", None, None, None)])).collect()
    assert one[0]["edited_sha256"] == sha("a b c d a b")  # its own next


def test_sketches_merge_and_estimate(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1500, 4500))
    df = spark.createDataFrame([("x", a), ("x", b)], "g string, text string").withColumn("s", fingerprint.sketch(F.col("text")))
    whole = fingerprint.merge_by(df, "g", "s").head()["sketch"]
    rows = df.collect()
    assert whole == sorted({*rows[0]["s"], *rows[1]["s"]})[:128]
    pair = spark.createDataFrame([(rows[0]["s"], rows[1]["s"], whole)], "a array<bigint>, b array<bigint>, m array<bigint>")
    got = pair.select(
        fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("m")).alias("n"), fingerprint.merged(F.col("a"), F.col("b")).alias("m")
    ).head()
    assert got["m"] == whole
    assert got["n"] == pytest.approx(4496, rel=0.3)
    assert got["c"] == pytest.approx(0.5, abs=0.2)


# ---------------------------------------------------------------- 2

def line_fails(line):
    words = WORD.findall(line)
    n = len(words)
    if not n:
        return False
    symbols = len(re.findall(quality.SYMBOLS, line))
    shouts = len(re.findall(quality.SHOUTS, line))
    bars = len(re.findall(quality.SEPARATORS, line, re.A))
    return bool(
        (symbols >= 3 and symbols * 10 > n * 3)
        or (shouts >= 3 and shouts * 5 > n)
        or bars >= 3
        or (bars >= 1 and n <= 5)
        or (n <= 20 and re.search(quality._BOILERPLATE, line, re.A))
        or (n <= 2 and not re.search(quality.CLOSING, line, re.A))
    )


def judged(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    full = [x for x in lines if WORD.search(x)]
    chars = sum(map(len, words))
    lost = sum(len(w) for x in lines if line_fails(x) for w in WORD.findall(x))
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), base, not base and lost <= 0.3 * chars


def awkward_texts():
    rng = random.Random(11)
    good = fixtures.words(rng, 90) + "."
    texts = [
        good,
        good + "\nHome | About | Contact\nAll rights reserved.\nx",
        good + "\n" + "\n".join("a | b" for _ in range(60)),
        good + "\n" + " ".join(w + "###" for w in fixtures.words(rng, 80).split()),
        good + "\n" + " ".join(w + "!!" for w in fixtures.words(rng, 80).split()),
        "\n".join([good] * 3),
        "same three words again " * 40,
        " ".join(f"a{i % 70} b{i % 70} c{i % 70}" for i in range(140)),
        good + "\n \n\t\n" + good,
    ]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def test_quality_rows(spark, tmp_path):
    data = fixtures.rows() + awkward_texts()
    got = Counter(map(tuple, queries.op2_quality(spark, fixtures.write(spark, tmp_path, data)).collect()))
    assert got == Counter((r[0], *judged(r[1])) for r in data)
    assert any(k[-1] for k in got) and any(not k[-1] and not k[-2] for k in got)
    assert queries.op2_quality(spark, fixtures.write(spark, tmp_path / "none", [])).count() == 0


def test_cleaning_keeps_columns(spark):
    data = fixtures.rows() + awkward_texts()
    docs = fixtures.frame(spark, data).withColumn("quality", F.lit(1)).withColumn("row", F.lit("x"))
    got = quality.cleaned(docs)
    assert got.columns == docs.columns
    want = Counter()
    for i, t, *_ in data:
        if judged(t)[-1]:
            want[(i, "\n".join(x for x in t.split("\n") if not line_fails(x)))] += 1
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


# ---------------------------------------------------------------- 6

def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    data = fixtures.rows()
    got = queries.op6_token_files(spark, fixtures.write(spark, tmp_path, data)).collect()
    want, at = defaultdict(Counter), 0
    for i, t, *_ in sorted(data, key=lambda r: LOW if r[0] is None else r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i][(len(ids), zlib.crc32(array("I", ids).tobytes()))] += 1
    seen = defaultdict(Counter)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        seen[r["doc_id"]][(r["n_tokens"], r["ids_crc32"])] += 1
    assert seen == want
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: LOW if i is None else i)
    assert queries.op6_token_files(spark, fixtures.write(spark, tmp_path / "none", [])).count() == 0


def test_token_files_are_selective(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "files")
    token_files.write_token_files(fixtures.frame(spark), path, queries.WORD_VOCABULARY)
    some = token_files.read_token_files(spark, path, 10, 30)
    assert sorted(r["doc_id"] for r in some.collect()) == sorted(r[0] for r in fixtures.rows() if r[0] is not None and 10 <= r[0] <= 30)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10), LessThanOrEqual(doc_id,30)]" in some._jdf.queryExecution().toString()
    meta = pq.ParquetFile(glob.glob(f"{path}/bucket=*/*.parquet")[0]).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["ids.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


# ---------------------------------------------------------------- 7

LICENSE_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+(?:[.\-][a-z0-9\x80-\U0010ffff]+)*")


def contained(text, template, share=0.8):
    """First word, words and containment of each match: runs of the template's shingles with gaps of its length at most."""
    own, words = LICENSE_WORD.findall(template.lower()), LICENSE_WORD.findall(text.lower())
    width = min(5, len(own))
    shingles = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
    places = [i for i in range(len(words) - width + 1) if tuple(words[i : i + width]) in shingles]
    runs = []
    for i in places:
        if runs and i - runs[-1][-1] <= len(own) - width + 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    for run in runs:
        c = len({tuple(words[i : i + width]) for i in run}) / len(shingles)
        if c >= share:
            yield run[0], run[-1] + width - run[0], c


def test_every_template_is_found_through_the_bands_when_damaged(spark):
    """Recall against exhaustive containment over texts with random damage, in documents of random length."""
    rng, data = random.Random(9), []
    for k, (_, template) in enumerate(license_scan.TEMPLATES):
        for _ in range(12):
            words = template.split()
            for _ in range(rng.randint(0, max(0, len(words) // 25))):
                rng.choice([lambda i: words.pop(i), lambda i: words.insert(i, "or"), lambda i: words.__setitem__(i, "else")])(rng.randrange(len(words)))
            parts = [fixtures.words(rng, rng.randint(0, 250)), " ".join(words), fixtures.words(rng, rng.randint(0, 250))]
            data.append((len(data), "\n".join(parts), None, None, None))
    want = {(i, k) for i, t, *_ in data for k, (_, template) in enumerate(license_scan.TEMPLATES) if any(contained(t, template))}
    got = {(r["doc_id"], r["template"]) for r in license_scan.scan(fixtures.frame(spark, data).withColumn("license", F.lit("x")).withColumn("template", F.lit(0))).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert {k for _, k in got} == set(range(len(license_scan.TEMPLATES)))


def test_license_scan(spark, tmp_path):
    rng = random.Random(2)
    noise = lambda n: fixtures.words(rng, n)
    mit = license_scan.TEMPLATES[4][1]
    damaged = mit.split()
    damaged[20] = "whatever"
    data = [
        (1, noise(300) + "\nReleased under the MIT License.\n" + noise(200), None, None, None),
        (2, noise(90) + " " + mit + " " + noise(90), None, None, None),
        (3, noise(90) + " " + " ".join(damaged) + " " + noise(10), None, None, None),
        (4, "All rights reserved.", None, None, None),
        (5, noise(500), None, None, None),
        (6, " ".join(mit.split()[:20]), None, None, None),
        (7, "Licensed under CC BY-NC 4.0.", None, None, None),
    ] + fixtures.rows()
    got = Counter(map(tuple, queries.op7_license_scan(spark, fixtures.write(spark, tmp_path, data)).collect()))
    want = Counter()
    for i, t, *_ in data:
        for k, (name, template) in enumerate(license_scan.TEMPLATES):
            want.update((i, name, k, *m) for m in contained(t or "", template))
    assert got == want
    by_doc = defaultdict(set)
    for i, name, *_ in got:
        by_doc[i].add(name)
    assert by_doc == {1: {"MIT"}, 2: {"MIT"}, 3: {"MIT"}, 4: {"Proprietary"}, 7: {"CC-BY-NC-4.0"}}
    assert queries.op7_license_scan(spark, fixtures.write(spark, tmp_path / "none", [])).count() == 0


# ---------------------------------------------------------------- 10

def test_sharding(spark, tmp_path):
    data = fixtures.rows() + [(1000 + i, "copy of one text", "en", "hot", 16) for i in range(400)]
    got = queries.op10_sharding(spark, fixtures.write(spark, tmp_path, data)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert queries.op10_sharding(spark, fixtures.write(spark, tmp_path / "none", [])).count() == 0


def shard_data():
    rng = random.Random(8)
    data = [(i, "x" * rng.randint(1, 300) + str(i), rng.choice(["en", "de"]), f"s{rng.randint(0, 5)}", 0) for i in range(3000)]
    data += [(5000 + i, "hot " * 40, rng.choice(["en", "fr"]), rng.choice(["hot", "s1"]), 0) for i in range(1000)]  # more than a shard
    data += [(7000 + i, "warm " * 30 + str(i % 9), "en", rng.choice(["hot", "s1"]), 0) for i in range(900)]
    return data


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    data = shard_data()
    text = {r[0]: r[1] for r in data}
    sizes, where = Counter(), defaultdict(set)
    for r in sharding.kd_shards(fixtures.frame(spark, data).withColumn("node", F.lit(1)).withColumn("tie", F.lit(1)).withColumn("weight", F.lit(2))).collect():
        sizes[r["shard"]] += r["size"]
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(sizes) == 16
    assert max(sizes.values()) - min(sizes.values()) < 0.06 * sum(sizes.values()) / 16
    assert [t for t, s in where.items() if len(s) > 1] == ["hot " * 40]  # only what exceeds a shard


def test_tree_equals_brute_force(spark):
    """The tree over the units' dimensions by sorting, without the narrowing."""
    rows = sharding._sized(fixtures.frame(spark, shard_data()[:3000]))
    placed = {(r["h1"], r["h2"]): r for r in sharding._placed(sharding.units(rows)).collect()}
    tie = {(r["h1"], r["h2"]): r["t"] for r in rows.select("h1", "h2", F.pmod(F.xxhash64("h1", "h2"), F.lit(sharding._TIES)).alias("t")).collect()}
    assert len({r[d] for r in placed.values() for d in ("d_source",)}) == 6
    want = {}

    def split(keys, node, level):
        if level == 4:
            want.update(dict.fromkeys(keys, node))
            return
        widest = max(sharding.DIMENSIONS, key=lambda d: max(placed[k][d] for k in keys) - min(placed[k][d] for k in keys))
        keys = sorted(keys, key=lambda k: (placed[k][widest], tie[k]))
        half, run = sum(placed[k]["weight"] for k in keys) / 2, 0
        for n, k in enumerate(keys, 1):
            run += placed[k]["weight"]
            if run >= half:
                break
        split(keys[:n], 2 * node, level + 1)
        split(keys[n:], 2 * node + 1, level + 1)

    split(list(placed), 0, 0)
    ids = {(r["h1"], r["h2"]): r["doc_id"] for r in rows.collect()}
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(fixtures.frame(spark, shard_data()[:3000])).collect()}
    assert got == {ids[k]: v for k, v in want.items()}
