"""Operator 4 against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import fixtures
from tessera.llm import components, queries, simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_rows(spark, tmp_path):
    data = fixtures.rows()
    prints = [fingerprint(r[1]) for r in data]
    label = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for k, r in zip(label, data):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(k)) for r, p, k in zip(data, prints, label))
    got = Counter(map(tuple, queries.op4_simhash(spark, fixtures.write(spark, tmp_path)).collect()))
    assert got == want


def test_empty(spark, tmp_path):
    assert queries.op4_simhash(spark, fixtures.write(spark, tmp_path, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.integers(1, 60))
def test_trie_join_equals_brute_force(seed, errors, spread):
    rng = random.Random(seed)
    centre = [rng.getrandbits(64) for _ in range(4)]
    codes = sorted({rng.choice(centre) ^ sum(1 << rng.randrange(spread) for _ in range(rng.randint(0, 6))) & (2**64 - 1) for _ in range(80)})
    parent = simhash.trie_join(np.array(codes, np.uint64), np.array([0]), errors)
    want = classes(codes, lambda a, b: (a ^ b).bit_count() <= errors)
    pairs = {(p, w) for p, w in zip(parent.tolist(), want)}
    assert len(pairs) == len({p for p, _ in pairs}) == len({w for _, w in pairs})


def test_majority_bits_of_long_runs():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 1, 254, 255, 256, 0, 511, 70_000, 3, 140_000, 0])
    hashes = rng.integers(0, 1 << 63, int(sizes.sum()), np.uint64) | (rng.integers(0, 8, int(sizes.sum()), np.uint64) << np.uint64(61))
    hashes[-50_000:] = np.uint64(2**64 - 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    ends = np.cumsum(sizes)
    want = [sum(1 << b for b in np.flatnonzero(2 * bits[e - n : e].sum(axis=0) > n).tolist()) for e, n in zip(ends, sizes)]
    assert simhash.majority_bits(hashes, sizes).tolist() == want
    assert simhash.majority_bits(np.array([], np.uint64), np.array([0, 0])).tolist() == [0, 0]


def test_parts_hold_linked_codes_together_and_others_rarely():
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(20_000)]
    for errors in range(1, 5):
        masks = simhash.shared_bits(errors)
        for a in codes[:500]:
            b = a ^ sum(1 << x for x in rng.sample(range(64), errors))
            assert any(a & m == b & m for m in masks)
    # unrelated codes in one part cost node pairs: fewer than the codes, where one shared block would give some 146,000 here
    met = Counter((m, c & m) for m in simhash.shared_bits(4) for c in codes)
    assert sum(n * (n - 1) // 2 for n in met.values()) < len(codes)


def test_links_equal_brute_force(spark):
    rng = random.Random(8)
    for errors in (1, 4):
        centre = [rng.getrandbits(64) for _ in range(30)]
        codes = sorted({rng.choice(centre) ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, errors + 1))) for _ in range(400)})
        signed = [c - (1 << 64 if c >> 63 else 0) for c in codes]
        roots = components.connected(simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), errors))
        got = {r["node"]: r["root"] for r in roots.collect()}
        want = classes(codes, lambda a, b: (a ^ b).bit_count() <= errors)
        pairs = {(got.get(c, c), w) for c, w in zip(signed, want)}
        assert len(pairs) == len({p for p, _ in pairs}) == len({w for _, w in pairs})


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i // 2) for i in range(1, 200)] + [(5000, i) for i in range(5001, 5300)]
    edges += [(7, 7), (None, 3), (3, None), (1, 2), (2, 1)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(301), *range(1000, 1200), *range(5000, 5300)}
    for part in (range(301), range(1000, 1200), range(5000, 5300)):
        assert len({got[i] for i in part}) == 1
    assert len(set(got.values())) == 3
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
