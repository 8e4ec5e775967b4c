"""Operator 4, SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64 majority bits over the XXH64 hashes of a text's word shingles.
Links: two fingerprints that differ in at most ``errors`` bits.

The trie is cut into independent parts by pigeonhole: of ``errors + SHARED``
blocks of bits, a linked pair agrees in ``SHARED`` at least, so each distinct
fingerprint goes to one part for each choice of so many blocks, and in a part a
trie self-join starts from the node of the shared blocks.  With one block of 12
bits a part's codes, and with them its node pairs, grow with the corpus from
the first; with two, chance leaves a part one code up to millions of them.  The
join walks node pairs together, adds up differing bits and drops a pair beyond
the budget.  Only connectivity is asked for, so the
walk runs with growing budgets and also drops pairs of nodes whose leaves are
all in one component already: a dense group costs no pairs of its members.
Parts give spanning links, which ``components.connected`` joins.

Very long texts are whole; a table may be empty or have other columns, which
are dropped.  A null text has no words; texts without words have fingerprint zero, which
links like any other.  A null doc_id is kept and never names a component
unless it is the only id there.  Repeated rows repeat in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import mapper
from tessera.llm.common import join_few, materialize, shuffle_partitions
from tessera.llm.components import connected

BITS = 64
ERRORS = 4
WIDTH = 4
SEED = 42
#: Node pairs held at once; a larger frontier is walked in halves.
FRONTIER = 1_000_000
#: Codes held at once, but for a larger single block value.
HELD_ROWS = 1 << 20
#: Blocks of bits in which the codes of a part agree.
SHARED = 2
#: Shingle hashes whose bits are counted at once.
COUNT_ROWS = 1 << 17
#: A byte's eight bits, each in a byte of its own: eight counters in one sum, up to so many hashes.
LANES = np.array([sum((v >> k & 1) << 8 * k for k in range(8)) for v in range(256)], "<u8")
LANE_ROWS = 255


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle; ASCII capitals are lowered, words are split at ASCII white space."""
    words = text.lower().split()
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(joined, seed)] if n else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes of the given sizes: the bits set in over half of each run."""
    ones = np.zeros((len(sizes), BITS), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(hashes), COUNT_ROWS):
        own = owner[a : a + COUNT_ROWS]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
        firsts = np.flatnonzero(place % LANE_ROWS == 0)
        lanes = LANES[hashes[a : a + COUNT_ROWS].view(np.uint8)].reshape(-1, 8)
        counts = np.add.reduceat(lanes, firsts, axis=0).view(np.uint8).reshape(-1, BITS)
        np.add.at(ones, own[firsts], counts)
    set_bits = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint as a signed long, and 64 bits that tell a row's text from others with its doc_id."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes(t or b"", width, seed) for t in batch.column(2).to_pylist()]
        sizes = np.array([len(x) for x in found], np.int64)
        hashes = np.fromiter(chain.from_iterable(found), np.uint64, int(sizes.sum()))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": pa.array(majority_bits(hashes, sizes).view(np.int64))})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.encode("text", "UTF-8").alias("text"))
    return narrow.mapInArrow(mapper(step, "text"), "doc_id long, text_hash long, fp long")


# ---------------------------------------------------------------- trie self-join

def _find(parent: np.ndarray) -> None:
    """Point every node at its root."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        _find(parent)


def _first_one(codes: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """For ranges of sorted codes that agree above ``bit``: where the codes with that bit begin, by bisection."""
    low, high = low.copy(), high.copy()
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) >> 1
        one = (codes[mid] >> np.uint64(bit)) & np.uint64(1) == 1
        high[live[one]] = mid[one]
        low[live[~one]] = mid[~one] + 1
    return low


def trie_join(codes: np.ndarray, firsts: np.ndarray, errors: int) -> np.ndarray:
    """Component labels within groups of sorted distinct codes; ``firsts`` are the groups' starts.

    A node is a range of codes that share their leading bits; its children are
    parted by bisection, so that nothing but the codes and labels is held.
    """
    n = len(codes)
    parent = np.arange(n)
    ends = np.r_[firsts[1:], n]
    many = ends - firsts > 1
    if not many.any():
        return parent
    for budget in sorted({1, 2, errors} & set(range(1, errors + 1))) or [0]:
        changes = np.r_[0, 0, np.cumsum(parent[1:] != parent[:-1])]  # index i: changes before position i
        zero = np.zeros(int(many.sum()), np.int64)
        stack = [(BITS - 1, firsts[many], ends[many], firsts[many], ends[many], zero)]
        while stack:
            bit, al, ah, bl, bh, diff = stack.pop()
            if len(al) > FRONTIER:
                half = len(al) // 2
                stack += [(bit, *(x[:half] for x in (al, ah, bl, bh, diff))), (bit, *(x[half:] for x in (al, ah, bl, bh, diff)))]
                continue
            am, bm = _first_one(codes, al, ah, bit), _first_one(codes, bl, bh, bit)
            twin = al == bl
            mixed = ~twin
            parts = [
                (al, am, bl, bm, diff),
                (am, ah, bm, bh, diff),
                (al, am, bm, bh, diff + 1),
                (am[mixed], ah[mixed], bl[mixed], bm[mixed], diff[mixed] + 1),
            ]
            al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts))
            live = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
            al, ah, bl, bh, diff = (x[live] for x in (al, ah, bl, bh, diff))
            # all leaves of both nodes in one component: nothing to learn
            known = (changes[ah] == changes[al + 1]) & (changes[bh] == changes[bl + 1]) & (parent[al] == parent[bl])
            single = (ah - al == 1) & (bh - bl == 1)
            leaf = single & ~known
            if leaf.any():
                a, b = al[leaf], bl[leaf]
                near = np.bitwise_count(codes[a] ^ codes[b]) <= budget
                _unite(parent, a[near], b[near])
            go = ~known & ~single
            if go.any():
                if bit == 0:
                    raise AssertionError("codes of a group must be distinct")
                stack.append((bit - 1, *(x[go] for x in (al, ah, bl, bh, diff))))
        _find(parent)
    return parent


def shared_bits(errors: int) -> list[int]:
    """A mask for each choice of ``SHARED`` of ``errors + SHARED`` blocks of bits; a linked pair agrees under one at least."""
    k = errors + SHARED
    cuts = [BITS * i // k for i in range(k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, SHARED)]


def links(codes: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``a, b``: links that span each component of a column ``fp`` of distinct fingerprints."""
    masks = [m - (1 << BITS if m >> (BITS - 1) else 0) for m in shared_bits(errors)]
    keys = [F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)]
    n = shuffle_partitions(codes.sparkSession)
    # a part is one task's at a time: its rows come sorted, so only one block value's codes are held
    dealt = codes.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.block", "key.value", "fp")
    dealt = dealt.repartition(n, "block", "value").sortWithinPartitions("block", "value")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of one block value, many small ones at a time."""
        held: list[tuple[np.ndarray, ...]] = []
        rows, limit = 0, HELD_ROWS

        def done(upto: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, limit
            block, value, fp = (np.concatenate(x) for x in zip(*held))
            change = np.flatnonzero((block[1:] != block[:-1]) | (value[1:] != value[:-1])) + 1
            cut = len(fp) if upto else (int(change[-1]) if len(change) else 0)
            held, rows = [(block[cut:], value[cut:], fp[cut:])], len(fp) - cut
            limit = max(HELD_ROWS, 2 * rows)
            firsts = np.r_[0, change[change < cut]]
            sizes = np.diff(np.r_[firsts, cut])
            # most codes are alone in their part
            met = np.repeat(sizes > 1, sizes)
            if met.any():
                sizes = sizes[sizes > 1]
                own = fp[:cut][met].view(np.uint64)
                own = own[np.lexsort((own, np.repeat(np.arange(len(sizes)), sizes)))]
                parent = trie_join(own, np.r_[0, np.cumsum(sizes)[:-1]], errors)
                linked = np.flatnonzero(parent != np.arange(len(own)))
                signed = own.view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(signed[linked]), "b": pa.array(signed[parent[linked]])})

        for batch in batches:
            if len(batch):
                held.append(tuple(np.asarray(c) for c in batch.columns))
                rows += len(batch)
                if rows >= limit:
                    yield from done(False)
        if rows:
            yield from done(True)

    return dealt.mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = ERRORS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id``: each row's fingerprint, its component, and the least doc_id that links reach."""
    prints = materialize(fingerprints(docs, width, seed), "prints")
    codes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    roots = connected(links(codes.select("fp"), errors))
    owned = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    owned = materialize(owned, "owned")
    least = owned.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_code = owned.join(least, "root").select("fp", "root", "component_id")
    # many rows of one fingerprint meet few rows: broadcast where their number allows, and skewed partitions are cut by AQE beyond
    return join_few(prints, materialize(by_code, "by-code"), "fp", "inner").select("doc_id", "text_hash", "fp", "root", "component_id")


def first_rows(docs: DataFrame, errors: int = ERRORS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row of each component: that with the least doc_id, then hash of the text; null doc_ids come after all others.

    Of rows that agree in doc_id and text one stays, the least by the hash of
    all its columns.
    """
    found = materialize(near_duplicates(docs.select("doc_id", "text"), errors, width, seed), "near-duplicates")
    named = found.select("root", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_doc"), F.col("text_hash").alias("_hash"))
    keepers = named.groupBy("root").agg(F.min(F.struct("_doc", "_hash")).alias("k")).select("k._doc", "k._hash")
    keepers = materialize(keepers.join(named.groupBy("_doc", "_hash").agg((F.count(F.lit(1)) > 1).alias("_many")), ["_doc", "_hash"]), "keepers")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.xxhash64("row.text").alias("_hash"))
    kept = join_few(keyed, keepers, ["_doc", "_hash"], "inner")
    once = kept.where("_many").groupBy("_doc", "_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    both = kept.where("not _many").select("row").unionAll(once.select("row"))
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
