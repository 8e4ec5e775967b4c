"""Operators over lowered rows and the index in both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import model

#: Edges on a page, and the most that may be asked for.
PAGE, MAX_PAGE, MAX_ELEMENTS = 20, 200, 200


def lower(*families: DataFrame) -> DataFrame:
    """One row table from all families, with edge ids."""
    rows = reduce(DataFrame.unionByName, families)
    return rows.withColumn("edge_id", model.edge_id(F.col("rel"), F.col("subject"), F.col("object")))


def bi_index(rows: DataFrame) -> DataFrame:
    """``position, rel, dir, other`` and the row's columns: every row at both of its ends.

    A directed row is forward at its subject and inverse at its object; a
    symmetric row has one direction.
    """
    both = model.is_symmetric(F.col("rel"))
    end = lambda p, o, d: F.struct(F.col(p).alias("position"), F.col(o).alias("other"), d.alias("dir"))
    ends = F.array(
        end("subject", "object", F.when(both, "both").otherwise("forward")),
        end("object", "subject", F.when(both, "both").otherwise("inverse")),
    )
    return rows.withColumn("_end", F.explode(ends)).select("_end.position", "rel", "_end.dir", "_end.other", "edge_id", "family", "row_ord", "votes", "narrative", "provenance")


def edge_summary(index: DataFrame) -> DataFrame:
    """``position, rel, dir, n_edges``: distinct edges of each kind that a position has."""
    edges = index.select("position", "rel", "dir", "edge_id").distinct()
    return edges.groupBy("position", "rel", "dir").agg(F.count(F.lit(1)).alias("n_edges"))


def first_rows(index: DataFrame) -> DataFrame:
    """Each distinct edge of a position and kind at its first row: one aggregate with map-side combine."""
    return index.groupBy("position", "rel", "dir", "edge_id", "other").agg(F.min(F.struct("family", "row_ord", "votes", "narrative")).alias("_f")).select(
        "position", "rel", "dir", "edge_id", "other", "_f.family", "_f.row_ord", "_f.votes", "_f.narrative"
    )


def edge_page(index: DataFrame, limit: int = PAGE) -> DataFrame:
    """The first page of every position and kind, ``place`` from 0.

    The limit is applied before the shuffle of the window, so a hub sends a
    page from each task.
    """
    limit = max(0, min(limit, MAX_PAGE))
    order = Window.partitionBy("position", "rel", "dir").orderBy("family", "row_ord", "edge_id")
    return first_rows(index).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < limit)


def edge_page_at(index: DataFrame, position: str, rel: str, direction: str, cursor: tuple[int, int] | None = None, limit: int = PAGE) -> DataFrame:
    """A page of one position from a cursor ``(family, row_ord)`` of a first row, and whether more follow (``next``)."""
    limit = max(0, min(limit, MAX_PAGE))
    mine = first_rows(index.where((F.col("position") == position) & (F.col("rel") == rel) & (F.col("dir") == direction)))
    if cursor is not None:
        mine = mine.where(F.struct("family", "row_ord") >= F.struct(F.lit(cursor[0]), F.lit(cursor[1]).cast("long")))
    rows = mine.orderBy("family", "row_ord", "edge_id").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("family", "row_ord", "edge_id"))  # over limit + 1 rows
    return rows.withColumn("place", place - 1).withColumn("next", F.col("place") == limit)


def node_page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Nodes in byte order of their ids."""
    return nodes.orderBy("id").offset(offset).limit(limit)


def elements(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes for asked ids ``place, id`` in their order; a missing one keeps its place."""
    asked = ids.where(F.col("place") < MAX_ELEMENTS)
    return asked.join(nodes, "id", "left").withColumn("missing", F.col("kind").isNull())


def edges_with_nodes(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """The index with its neighbours' kind and label; an edge as neighbour has none."""
    named = nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("label").alias("other_label"))
    return index.join(named, "other", "left")


def step(frontier: DataFrame, index: DataFrame, rel: str, direction: str) -> DataFrame:
    """Follow one kind of edge from ``start, position``: distinct ends."""
    hop = index.where((F.col("rel") == rel) & (F.col("dir") == direction)).select("position", "other")
    return frontier.join(hop, "position").select("start", F.col("other").alias("position")).distinct()


def path(frontier: DataFrame, index: DataFrame, *kinds: tuple[str, str]) -> DataFrame:
    """Follow kinds of edges one after the other."""
    return reduce(lambda at, kind: step(at, index, *kind), kinds, frontier)


def inverse_gaps(index: DataFrame) -> DataFrame:
    """Index entries whose other end has no entry of the dual direction: none if the index is sound.

    Both ends of an edge meet in one aggregate by their unordered pair: each
    side says which of the two it has.
    """
    low, high = F.least("position", "other"), F.greatest("position", "other")
    inverse = F.col("dir") == "inverse"
    # the edge as its forward side has it
    subject, object_ = F.when(inverse, F.col("other")).otherwise(F.col("position")), F.when(inverse, F.col("position")).otherwise(F.col("other"))
    both = F.col("dir") == "both"
    keyed = index.select("rel", "edge_id", both.alias("even"), F.when(both, low).otherwise(subject).alias("x"), F.when(both, high).otherwise(object_).alias("y"), (inverse | (both & (F.col("position") > F.col("other")))).alias("back"))
    sides = keyed.groupBy("rel", "edge_id", "even", "x", "y").agg(F.bool_or(~F.col("back")).alias("there"), F.bool_or("back").alias("again"))
    alone = sides.where(~(F.col("there") & F.col("again")) & ~(F.col("even") & (F.col("x") == F.col("y"))))
    position, other = F.when(F.col("there"), F.col("x")).otherwise(F.col("y")), F.when(F.col("there"), F.col("y")).otherwise(F.col("x"))
    direction = F.when(F.col("even"), "both").when(F.col("there"), "forward").otherwise("inverse")
    return alone.select(position.alias("position"), other.alias("other"), "rel", direction.alias("dir"), "edge_id")


def rows_behind(rows: DataFrame) -> DataFrame:
    """``edge_id, n_rows, first_family, first_ord``: the rows that make each edge, the first in row order."""
    return rows.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("family", "row_ord")).alias("_f")).select(
        "edge_id", "n_rows", F.col("_f.family").alias("first_family"), F.col("_f.row_ord").alias("first_ord")
    )


def provenance_sets(rows: DataFrame, *by: str) -> DataFrame:
    """Sorted distinct provenances of each group, joined by commas."""
    return rows.select(*by, "provenance").distinct().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("provenance")), ",").alias("provenances"))


def positions(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes and all ends of the index."""
    return nodes.select(F.col("id").alias("position")).unionByName(index.select("position")).distinct()


def dangling(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rel, side, position, n_rows``: ends without a node."""
    ends = rows.select("rel", F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject").alias("p")), F.struct(F.lit("object").alias("side"), F.col("object").alias("p")))).alias("e"))
    found = ends.select("rel", "e.side", F.col("e.p").alias("position")).join(nodes.select(F.col("id").alias("position")), "position", "left_anti")
    return found.groupBy("rel", "side", "position").agg(F.count(F.lit(1)).alias("n_rows"))


def many_parents(rows: DataFrame) -> DataFrame:
    """``child, n_parents``: children with more than one container, which a forest hasn't."""
    return rows.where("rel = 'Contains'").groupBy(F.col("object").alias("child")).agg(F.count_distinct("subject").alias("n_parents")).where("n_parents > 1")


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """``ancestor, descendant, steps`` of edges ``parent, child``: the shortest way, up to ``depth`` steps.

    Doubles its reach each round, and each round is cut off by a checkpoint.
    """
    reach = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("steps")).distinct()
    span = 1
    while span < depth:
        more = reach.alias("a").join(reach.alias("b"), F.col("a.descendant") == F.col("b.ancestor"))
        longer = more.select("a.ancestor", "b.descendant", (F.col("a.steps") + F.col("b.steps")).alias("steps")).where(F.col("steps") <= depth)
        reach = reach.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("steps").alias("steps"))
        span *= 2
        if reach.sparkSession.sparkContext.getCheckpointDir():
            reach = reach.checkpoint()
    return reach


def _settled(df: DataFrame) -> DataFrame:
    """Cut off the lineage of a round, where there is a folder for it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def cycles(edges: DataFrame) -> DataFrame:
    """``node``: nodes on a cycle of edges ``parent, child``, or on a way from one cycle to another.

    Edges from a node without parents or to one without children are taken away
    until none is left, whatever the cycles' lengths; a graph without cycles
    gives no rows.  The rounds are as many as the longest way outside.
    """
    left = _settled(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    rows = left.count()
    while rows:
        kept = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        left = _settled(kept.join(kept.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        before, rows = rows, left.count()
        if rows == before:
            break
    return left.select(F.col("parent").alias("node")).distinct()


def forest_laws(edges: DataFrame) -> DataFrame:
    """``law, node`` of edges ``parent, child`` that aren't a forest: repeated edges, several parents, cycles."""
    law = lambda df, name, column: df.select(F.lit(name).alias("law"), F.col(column).alias("node"))
    repeated = edges.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("child").distinct()
    several = edges.groupBy("child").agg(F.count_distinct("parent").alias("n")).where("n > 1")
    return law(repeated, "repeated", "child").unionByName(law(several, "parents", "child")).unionByName(law(cycles(edges), "cycle", "node"))


def siblings(parents: DataFrame) -> DataFrame:
    """``child, sibling`` of edges ``parent, child``: others with a common parent."""
    a, b = parents.alias("a"), parents.alias("b")
    return a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.child") != F.col("b.child"))).select("a.child", F.col("b.child").alias("sibling")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: the least node that edges ``a, b`` reach, by least labels with short cuts, until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select("node", F.col("node").alias("component"))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = least.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old")
        new = _settled(new)
        label = new.select("node", "component")
        if new.where("component <> old").head() is None:
            break
    return label


def lookup_first(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
