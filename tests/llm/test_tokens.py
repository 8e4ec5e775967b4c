"""Operators 3 and 5 against the library itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import fixtures
from tessera.llm import bpe, bpe_codec, packing, queries
from tessera.llm.bpe import byte_bpe, pack, word_bpe

BYTE, WORD = queries.BYTE_VOCABULARY, queries.WORD_VOCABULARY
MIXED = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sre<|>é 　\x1c\x85")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_fast_encoders_equal_the_library(text):
    for codec in (byte_bpe(BYTE), word_bpe(WORD)):
        assert codec.encode(text) == pack(codec.library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'rels!1é中 \n", min_size=20, max_size=400), st.integers(3, 40))
def test_tree_concatenation_is_exact(text, leaf):
    codec = byte_bpe(BYTE)
    assert codec.encode_long(text, leaf) == pack(codec.library.encode(text, add_special_tokens=False).ids)


def expected(library, data):
    return [(i, t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in data]


def test_codec_rows(spark, tmp_path, library):
    data = fixtures.rows()
    got = Counter(map(tuple, queries.op5_bpe_codec(spark, fixtures.write(spark, tmp_path)).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids), sha(pack(ids)), sha(library.decode(ids, skip_special_tokens=False).encode())) for i, t, ids in expected(library, data))
    assert got == want


def test_codec_empty(spark):
    assert bpe_codec.encode_decode(fixtures.frame(spark, []), BYTE).count() == 0


def test_packing_rows(spark, tmp_path, library):
    data = fixtures.rows()
    got = queries.op3_packing(spark, fixtures.write(spark, tmp_path)).collect()
    want = Counter()
    for i, t, ids in expected(library, data):
        ids = [*ids, 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[(i, a, len(part), zlib.crc32(array("I", part).tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_empty(spark, tmp_path):
    assert queries.op3_packing(spark, fixtures.write(spark, tmp_path, [])).count() == 0


def test_histogram_packing_pads_little():
    rng = random.Random(3)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    packs = packing.pack_histogram(dict(histogram), 2048)
    placed = Counter()
    for pattern, count in packs:
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += count
    assert placed == histogram
    filled = sum(k * v for k, v in histogram.items())
    assert filled / (2048 * sum(count for _, count in packs)) > 0.99


def test_a_frequent_word_is_remembered_when_a_cache_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    asked = Counter()

    def ask(word):
        asked[word] += 1
        return word.encode()

    cache = bpe._Cache(ask)
    for k in range(200):
        assert cache["the"] == b"the" and cache[str(k)] == str(k).encode()
        assert len(cache) + len(cache.old) <= 10
    assert asked["the"] == 1


def test_letters_and_marks_are_pieces_of_their_own(monkeypatch):
    codec = word_bpe(WORD)
    words = [a + b for a in ("The", "\u00c9t\u00e9", "\u0139e") for b in ("", ".", "',", "?!", "&&&", "_", "'s")]
    monkeypatch.setattr(codec, "pattern", None)  # only a word that isn't so is cut by the pattern
    for word in words:
        if not word.endswith("'s"):
            assert codec._word(word) == pack(codec.library.encode(word, add_special_tokens=False).ids)
