"""The pipeline's stages against their operators' brute-force versions."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures
from tests.llm.test_simhash import classes, fingerprint
from tests.llm.test_texts import awkward_texts, judged
from tessera.llm.bpe import byte_bpe
from tessera.llm.queries import BYTE_VOCABULARY


LAST = float("inf")


def test_stages_and_run(spark, tmp_path):
    data = fixtures.rows() + [(900 + i, t, *rest) for i, t, *rest in awkward_texts()]
    folder = fixtures.write(spark, tmp_path, data)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = f"{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        after = docs.collect()
        if name == "quality_rules":
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if judged(r["text"])[-1])
        if name == "line_dedup":
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
        if name == "simhash_near_dedup":
            label = classes([fingerprint(r["text"]) for r in before], lambda a, b: (a ^ b).bit_count() <= 4)
            least = {}
            for k, r in zip(label, before):
                least[k] = min(least.get(k, LAST), LAST if r["doc_id"] is None else r["doc_id"])
            assert Counter(LAST if r["doc_id"] is None else r["doc_id"] for r in after) == Counter(least.values())
    codec = byte_bpe(BYTE_VOCABULARY)
    want = Counter()
    for r in docs.collect():
        ids = [*memoryview(codec.encode(r["text"] or "")).cast("I"), 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[(r["doc_id"], a, len(part), zlib.crc32(array("I", part).tobytes()), len(ids))] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    used = defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, fixtures.write(spark, tmp_path, [])).count() == 0


def test_short_repeated_lines_go(spark, tmp_path):
    data = [(k, f"Les.\nA line that only document {k * 1001} has.\n\nx\nx", None, None, None) for k in (1, 2, 3)]
    docs = fixtures.frame(spark, data)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()}
    assert got == {1: "Les.\nA line that only document 1001 has.\n\nx", 2: "A line that only document 2002 has.\n", 3: "A line that only document 3003 has.\n"}


def test_repeated_rows_and_shared_ids_leave_one_row(spark, tmp_path):
    text, other = fixtures.words(random.Random(1), 80), fixtures.words(random.Random(2), 80)
    data = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (5, text, "en", "b", 1), (5, other, "en", "b", 1), (None, other, None, None, None), (None, text + " x", None, None, None)]
    got = corpus_pipeline.near_dedup(spark, fixtures.frame(spark, data), str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, text), (5, other)])
    alone = [(None, text, None, None, None)] * 3
    assert corpus_pipeline.near_dedup(spark, fixtures.frame(spark, alone), str(tmp_path)).count() == 1


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = fixtures.frame(spark).drop("n_chars")
    for name in ("_quality", "row", "removed", "_doc", "root", "fp"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).count() > 0
