"""Operator 10, sharding by a k-d tree over document metadata.

Equal texts are one unit, with their bytes together, the least source, language
and doc_id of the copies.  Each node of the tree is split along its widest
dimension at the weighted quantile that fits the capacities of the shards below
it, until the leaves are the shards.  Dimensions, each on a scale from 0 to
``SCALE``: length (logarithm of the size), doc_id, and source and language, as
places in the order of their bytes, heaviest first.  The law is ``bytes``.

Units are placed whole.  Those with more than ``1 / HEAVY`` of a shard's bytes,
at most ``HEAVY`` times the shards in number, would unsettle the quantiles; they
go first, heaviest first, each to the shard with the least in it, and the tree
fills the capacities that are left.  Only a unit with more than a whole shard's
bytes is divided: its rows are units of their own.

A quantile is found by narrowing: the span of the values is cut into intervals,
their weights are summed in one distributed aggregate for all nodes of a level
at once, and the interval with the quantile becomes the next span, until it is a
single value.  Units that tie at that value are divided by a hash in the same
way.  The driver sees intervals' sums only: nodes times intervals numbers.

Null texts are empty texts and weigh one byte; null source and language are the
empty name; null doc_ids count as 0 in their dimension.  Repeated rows are
copies.  An empty table gives no rows; with fewer units than shards some shards
are empty.  A text longer than a shard has a shard of its own at best.  Extra
columns are dropped, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_few, materialize, ranked

SHARDS = 16
INTERVALS = 1024
SCALE = 1 << 20
#: Units of more than this part of a shard are placed before the tree.
HEAVY = 32
DIMENSIONS = ("d_length", "d_source", "d_lang", "d_id")
_TIES = 1 << 40


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )


def _by_weight(units: DataFrame, name: str) -> DataFrame:
    """``name, d_name``: each value's place in the order of bytes.

    Values are binned by the logarithm of their bytes, 16 bins to a doubling;
    the bins' sums are added up, and a value lies in its bin by its hash.
    """
    weights = units.groupBy(name).agg(F.sum("weight").alias("w"))
    binned = materialize(weights.withColumn("bin", F.floor(F.log2("w") * 16).cast("int")), f"{name}-weights")
    bins = sorted(binned.groupBy("bin").agg(F.sum("w").alias("w")).collect(), reverse=True)  # at most 1,024
    total, before, spans = sum(r["w"] for r in bins) or 1, 0, {}
    for r in bins:
        spans[r["bin"]] = (before / total, r["w"] / total)
        before += r["w"]
    if not spans:
        return binned.select(name, F.lit(0).cast("long").alias(f"d_{name}"))
    start, width = (_by_key({k: v[i] for k, v in spans.items()}, "bin") for i in (0, 1))
    within = F.pmod(F.xxhash64(name), F.lit(SCALE)) / SCALE
    return binned.select(name, F.floor((start + width * within) * (SCALE - 1)).cast("long").alias(f"d_{name}"))


def units(rows: DataFrame) -> DataFrame:
    """``h1, h2, weight, size, source, lang, id``: equal texts together."""
    grouped = rows.groupBy("h1", "h2").agg(
        F.sum("size").alias("weight"), F.min("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min(F.coalesce("doc_id", F.lit(0))).alias("id")
    )
    return materialize(grouped, "units")


def _placed(table: DataFrame) -> DataFrame:
    """Add the dimensions to units."""
    spans = table.agg(F.min("size").alias("a"), F.max("size").alias("b"), F.min("id").alias("c"), F.max("id").alias("d")).head()
    logs = lambda v: F.log2(v + F.lit(1.0))
    share = lambda v, low, high: F.floor((v - low) / F.greatest(high - low, F.lit(1e-9)) * SCALE).cast("long")
    out = table.withColumn("d_length", share(logs(F.col("size")), logs(F.lit(spans["a"] or 0)), logs(F.lit(spans["b"] or 0))))
    out = out.withColumn("d_id", share(F.col("id").cast("double"), F.lit(float(spans["c"] or 0)), F.lit(float(spans["d"] or 0))))
    for name in ("source", "lang"):
        out = join_few(out, _by_weight(table, name), name, "inner")
    return out


def _quantiles(table: DataFrame, column: str, nodes: dict[int, tuple[int, int, float]]) -> dict[int, tuple[int, float]]:
    """For each node the value at which its weight reaches the target, and the weight below that value.

    ``nodes``: a node's least and greatest value and the target.
    """
    found: dict[int, tuple[int, float]] = {}
    spans = {k: (low, high, 0.0, target) for k, (low, high, target) in nodes.items()}
    while spans:
        steps = {k: max(1, -(-(high - low + 1) // INTERVALS)) for k, (low, high, _, _) in spans.items()}
        spec = [(k, low, steps[k], high) for k, (low, high, _, _) in spans.items()]
        edges = F.broadcast(table.sparkSession.createDataFrame(spec, "node int, _low long, _step long, _high long"))
        sums = (
            table.join(edges, "node")
            .where(F.col(column).between(F.col("_low"), F.col("_high")))
            .groupBy("node", F.expr(f"int(({column} - _low) div _step)").alias("cell"))
            .agg(F.sum("weight").alias("weight"))
            .collect()  # at most INTERVALS numbers for each node
        )
        cells: dict[int, dict[int, int]] = {}
        for r in sums:
            cells.setdefault(r["node"], {})[r["cell"]] = r["weight"]
        for k, (low, high, below, target) in list(spans.items()):
            for cell in sorted(cells[k]):
                if below + cells[k][cell] >= target:
                    break
                below += cells[k][cell]
            else:
                below -= cells[k][cell]  # the target is beyond all: the last interval
            start = low + cell * steps[k]
            if steps[k] == 1:
                found[k] = (start, below)
                del spans[k]
            else:
                spans[k] = (start, min(high, start + steps[k] - 1), below, target)
    return found


def _by_key(values: dict, column: str = "node") -> Column:
    """A literal for each key, looked up by the column."""
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col(column)]


def _split(table: DataFrame, level: int, levels: int, room: list[float]) -> DataFrame:
    """One level of the tree: node k becomes 2k and 2k + 1."""
    spread = [f(n).alias(f"{p}_{n}") for n in DIMENSIONS for p, f in (("min", F.min), ("max", F.max))]
    stats = table.groupBy("node").agg(F.sum("weight").alias("weight"), *spread).collect()  # one row for each node
    if not stats:
        return table
    below = 1 << (levels - level - 1)  # shards below a child
    fill = lambda child: sum(room[child * below : (child + 1) * below])
    share = {r["node"]: fill(2 * r["node"]) / ((fill(2 * r["node"]) + fill(2 * r["node"] + 1)) or 1) for r in stats}
    widest = {r["node"]: max(DIMENSIONS, key=lambda n: r[f"max_{n}"] - r[f"min_{n}"]) for r in stats}
    target = {r["node"]: r["weight"] * share[r["node"]] for r in stats}
    axis = _by_key({k: DIMENSIONS.index(n) for k, n in widest.items()})
    valued = table.withColumn("v", F.element_at(F.array(*DIMENSIONS), axis + 1))
    middles = _quantiles(valued, "v", {r["node"]: (r[f"min_{widest[r['node']]}"], r[f"max_{widest[r['node']]}"], target[r["node"]]) for r in stats})
    middle = _by_key({k: v for k, (v, _) in middles.items()})
    tied = valued.where(F.col("v") == middle)
    spans = tied.groupBy("node").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).collect()
    ties = _quantiles(tied, "tie", {r["node"]: (r["low"], r["high"], target[r["node"]] - middles[r["node"]][1]) for r in spans})
    last = _by_key({k: t for k, (t, _) in ties.items()})
    right = (F.col("v") > middle) | ((F.col("v") == middle) & (F.col("tie") > last))
    return materialize(valued.withColumn("node", F.col("node") * 2 + right.cast("int")).drop("v"), "kd-level")


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; the number of shards is a power of two."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("the number of shards must be a power of two")
    rows = materialize(_sized(docs).withColumn("row", F.monotonically_increasing_id()), "sized")
    found = _placed(units(rows))
    found = materialize(found.withColumn("tie", F.pmod(F.xxhash64("h1", "h2"), F.lit(_TIES))), "kd-units")
    target = (found.agg(F.sum("weight")).head()[0] or 0) / shards
    heavy = found.where(F.col("weight") > target / HEAVY).select("h1", "h2", "weight").collect()  # less than HEAVY times shards
    whole = sorted((r for r in heavy if r["weight"] <= target), key=lambda r: (-r["weight"], r["h1"], r["h2"]))
    loads = [(0, k) for k in range(shards)]
    fixed = []
    for r in whole:
        load, k = heapq.heappop(loads)
        heapq.heappush(loads, (load + r["weight"], k))
        fixed.append((r["h1"], r["h2"], k))
    divided = [(r["h1"], r["h2"]) for r in heavy if r["weight"] > target]
    room = [max(0.0, target - load) for load, _ in sorted(loads, key=lambda x: x[1])]
    spark = docs.sparkSession
    first = spark.createDataFrame(fixed, "h1 long, h2 long, fixed int")
    apart = spark.createDataFrame(divided, "h1 long, h2 long")
    light = found.join(F.broadcast(first), ["h1", "h2"], "left_anti")
    plain = light.join(F.broadcast(apart), ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(-1).cast("long").alias("row"), "weight", "tie", *DIMENSIONS)
    own = rows.select("h1", "h2", "row", F.col("size").alias("weight")).join(F.broadcast(light.join(F.broadcast(apart), ["h1", "h2"], "left_semi").select("h1", "h2", *DIMENSIONS)), ["h1", "h2"])
    single = own.select("h1", "h2", "row", "weight", F.pmod(F.xxhash64("h1", "row"), F.lit(_TIES)).alias("tie"), *DIMENSIONS)
    table = materialize(plain.unionByName(single).withColumn("node", F.lit(0)), "kd")
    for level in range(levels):
        table = _split(table, level, levels, room)
    leaves = table.select("h1", "h2", F.col("row").alias("_row"), "node")
    # few heavy units have most copies: they meet their rows by broadcast, all others are small
    known = rows.join(F.broadcast(first), ["h1", "h2"], "left")
    big = known.where("fixed is not null").withColumn("node", F.col("fixed"))
    parted = known.where("fixed is null").join(F.broadcast(apart.withColumn("apart", F.lit(True))), ["h1", "h2"], "left")
    some = parted.where("apart").join(leaves.where("_row >= 0").select(F.col("_row").alias("row"), "node"), "row")
    rest = parted.where("apart is null").join(leaves.where("_row < 0").select("h1", "h2", "node"), ["h1", "h2"])
    names = ("doc_id", "size", "text_crc32", F.col("node").alias("shard"), "row")
    joined = big.select(*names).unionByName(some.select(*names)).unionByName(rest.select(*names))
    return ranked(materialize(joined, "sharded"), ["shard"], ["row"], "slot").drop("row")


def digests(placed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
