"""Connected components of a link table by repeated contraction.

Each round every node takes the least neighbour, itself included, by a hashed
order; links between nodes that took the same one vanish and the rest are
re-drawn between the taken nodes.  A hashed order shrinks long paths by a
constant factor a round in expectation, and a star in one round.  The rounds'
maps are then composed backwards.  Links, nodes and maps stay in tables; the
driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def connected(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node with a link to another node.

    Links may repeat, point either way or join a node to itself; null ends are
    ignored.  Equal root means connected.  The root is a node of the component,
    but which one is not defined.
    """
    edges = materialize(
        links.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "links",
    )
    rounds: list[DataFrame] = []
    while edges.head() is not None:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        taken = nearest.select(F.col("u").alias("node"), F.least("m", own)["v"].alias("root"))
        step = materialize(taken, "round")
        rounds.append(step)
        a = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = materialize(
            edges.join(a, "u")
            .join(b, "v")
            .where(F.col("ru") != F.col("rv"))
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct(),
            "links",
        )
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # roots of the last round are final; a root of an earlier round is looked up in the next one
    out = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        out = materialize(step.join(later, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "map")
    return out
