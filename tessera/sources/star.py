"""Binding of the graph model to the star tables.

=============  ==========================================================
container      region holds nation; nation holds customers and suppliers
event          order: a range of zero-less years, at its customer's nation
narrative      a customer's orders by date and key
citation       neighbouring parts of one order, quantity as votes
analogue       neighbouring suppliers of one nation
text spine     turns of conversations, by conversation and turn
=============  ==========================================================

A calendar year y becomes y - 1998, and 0 or less one lower, so that there is
no year zero.  Rows are ordered by family and a key of the row, never by place
in a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.model import node_id
from tessera.operators import graph

EPOCH = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zeroless(date: Column) -> Column:
    y = F.year(date) - EPOCH
    return F.when(y <= 0, y - 1).otherwise(y)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, kind, label``."""

    def of(name: str, kind: str, prefix: str, key: str, label: str) -> DataFrame:
        return table(spark, sf_dir, name).select(node_id(kind, F.concat(F.lit(prefix), F.col(key))).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))

    parts = [
        of("region", "Container", "region-", "r_regionkey", "r_name"),
        of("nation", "Place", "nation-", "n_nationkey", "n_name"),
        of("customer", "Person", "customer-", "c_custkey", "c_name"),
        of("supplier", "PeopleGroup", "supplier-", "s_suppkey", "s_name"),
        of("orders", "Event", "order-", "o_orderkey", "o_orderpriority"),
        of("part", "TextUnit", "part-", "p_partkey", "p_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _family(df: DataFrame, number: int, rel: str, subject: Column, obj: Column, order: str, provenance: Column, votes: Column | None = None, narrative: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(number).alias("family"),
        F.col(order).cast("long").alias("row_ord"),
        F.lit(rel).alias("rel"),
        subject.alias("subject"),
        obj.alias("object"),
        (votes if votes is not None else F.lit(None)).cast("long").alias("votes"),
        (narrative if narrative is not None else F.lit(None)).cast("string").alias("narrative"),
        provenance.alias("provenance"),
    )


def _id(kind: str, prefix: str, key: str) -> Column:
    return node_id(kind, F.concat(F.lit(prefix), F.col(key)))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_key, from_part, to_part, votes``: parts of an order in key order, each citing the next."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("votes"))
    to = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))
    return lines.select(F.col("l_orderkey").alias("o_key"), F.col("l_partkey").alias("from_part"), to.alias("to_part"), "votes").where("to_part is not null")


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``narrative, prior, next``: consecutive orders of a customer."""
    then = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("narrative"), F.col("o_orderkey").alias("prior"), then.alias("next")).where("next is not null")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families, lowered."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    twin = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    star = F.lit("star")
    families = [
        _family(t("nation"), 1, "Contains", _id("Container", "region-", "n_regionkey"), _id("Place", "nation-", "n_nationkey"), "n_nationkey", star),
        _family(t("customer"), 2, "Contains", _id("Place", "nation-", "c_nationkey"), _id("Person", "customer-", "c_custkey"), "c_custkey", F.col("c_mktsegment")),
        _family(t("supplier"), 3, "Contains", _id("Place", "nation-", "s_nationkey"), _id("PeopleGroup", "supplier-", "s_suppkey"), "s_suppkey", star),
        _family(orders, 4, "LocatedAt", _id("Event", "order-", "o_orderkey"), _id("Place", "nation-", "c_nationkey"), "o_orderkey", F.col("o_orderpriority")),
        _family(t("orders"), 5, "Participates", _id("Person", "customer-", "o_custkey"), _id("Event", "order-", "o_orderkey"), "o_orderkey", F.col("o_orderpriority")),
        _family(succession(spark, sf_dir), 6, "Succession", _id("Event", "order-", "prior"), _id("Event", "order-", "next"), "prior", star, narrative=F.col("narrative")),
        _family(citations(spark, sf_dir), 7, "Cites", _id("TextUnit", "part-", "from_part"), _id("TextUnit", "part-", "to_part"), "o_key", F.lit("lines"), votes=F.col("votes")),
        _family(t("supplier").withColumn("twin", twin).where("twin is not null"), 8, "Analogue", _id("PeopleGroup", "supplier-", "s_suppkey"), _id("PeopleGroup", "supplier-", "twin"), "s_suppkey", star),
    ]
    return graph.lower(*families)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bi_index(rows(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event, narrative, place, from_year, to_year, order_date``: orders as dated events."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    orders = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    placed = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    first = zeroless(F.col("o_orderdate"))
    last = F.greatest(first, F.coalesce(zeroless(F.col("shipped")), first))
    return placed.select(
        F.col("o_orderkey").alias("event"),
        F.col("o_custkey").alias("narrative"),
        F.col("c_nationkey").alias("place"),
        first.cast("int").alias("from_year"),
        last.cast("int").alias("to_year"),
        F.col("o_orderdate").alias("order_date"),
    )


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chapter, verse, text``: turns in reading order (``chapter``, ``verse``)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("verse"), "text")


# ---------------------------------------------------------------- the same in SQL, for oracles

NODES_SQL = """nodes AS (
  SELECT 'Container:region-' || r_regionkey AS id, 'Container' AS kind, r_name AS label FROM region
  UNION ALL SELECT 'Place:nation-' || n_nationkey, 'Place', n_name FROM nation
  UNION ALL SELECT 'Person:customer-' || c_custkey, 'Person', c_name FROM customer
  UNION ALL SELECT 'PeopleGroup:supplier-' || s_suppkey, 'PeopleGroup', s_name FROM supplier
  UNION ALL SELECT 'Event:order-' || o_orderkey, 'Event', o_orderpriority FROM orders
  UNION ALL SELECT 'TextUnit:part-' || p_partkey, 'TextUnit', p_name FROM part)"""

CITES_SQL = """cites AS (
  SELECT o_key, from_part, to_part, votes FROM (
    SELECT l_orderkey AS o_key, l_partkey AS from_part, CAST(q AS BIGINT) AS votes,
           lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS to_part
    FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE to_part IS NOT NULL)"""

ROWS_SQL = f"""{CITES_SQL}, authored AS (
  SELECT 1 AS family, CAST(n_nationkey AS BIGINT) AS row_ord, 'Contains' AS rel, 'Container:region-' || n_regionkey AS subject,
         'Place:nation-' || n_nationkey AS object, CAST(NULL AS BIGINT) AS votes, CAST(NULL AS VARCHAR) AS narrative, 'star' AS provenance FROM nation
  UNION ALL SELECT 2, c_custkey, 'Contains', 'Place:nation-' || c_nationkey, 'Person:customer-' || c_custkey, NULL, NULL, c_mktsegment FROM customer
  UNION ALL SELECT 3, s_suppkey, 'Contains', 'Place:nation-' || s_nationkey, 'PeopleGroup:supplier-' || s_suppkey, NULL, NULL, 'star' FROM supplier
  UNION ALL SELECT 4, o_orderkey, 'LocatedAt', 'Event:order-' || o_orderkey, 'Place:nation-' || c_nationkey, NULL, NULL, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 5, o_orderkey, 'Participates', 'Person:customer-' || o_custkey, 'Event:order-' || o_orderkey, NULL, NULL, o_orderpriority FROM orders
  UNION ALL SELECT 6, prior, 'Succession', 'Event:order-' || prior, 'Event:order-' || nxt, NULL, CAST(o_custkey AS VARCHAR), 'star' FROM (
    SELECT o_custkey, o_orderkey AS prior, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL
  UNION ALL SELECT 7, o_key, 'Cites', 'TextUnit:part-' || from_part, 'TextUnit:part-' || to_part, votes, NULL, 'lines' FROM cites
  UNION ALL SELECT 8, s_suppkey, 'Analogue', 'PeopleGroup:supplier-' || s_suppkey, 'PeopleGroup:supplier-' || twin, NULL, NULL, 'star' FROM (
    SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS twin FROM supplier) WHERE twin IS NOT NULL),
rows_ AS (SELECT *, rel || ':' || substr(sha256(rel || chr(10) ||
    CASE WHEN rel = 'Analogue' THEN least(subject, object) ELSE subject END || chr(10) ||
    CASE WHEN rel = 'Analogue' THEN greatest(subject, object) ELSE object END), 1, 32) AS edge_id FROM authored)"""

INDEX_SQL = f"""{ROWS_SQL}, idx AS (
  SELECT subject AS position, rel, CASE WHEN rel = 'Analogue' THEN 'both' ELSE 'forward' END AS dir, object AS other, edge_id, family, row_ord, votes, narrative, provenance FROM rows_
  UNION ALL SELECT object, rel, CASE WHEN rel = 'Analogue' THEN 'both' ELSE 'inverse' END, subject, edge_id, family, row_ord, votes, narrative, provenance FROM rows_)"""

_ZERO = "CASE WHEN year({0}) - 1998 <= 0 THEN year({0}) - 1999 ELSE year({0}) - 1998 END"
EVENTS_SQL = f"""ev AS (
  SELECT o_orderkey AS event, o_custkey AS narrative, c_nationkey AS place, CAST(f AS INT) AS from_year, CAST(greatest(f, coalesce(t, f)) AS INT) AS to_year, o_orderdate AS order_date FROM (
    SELECT o.*, c_nationkey, {_ZERO.format('o_orderdate')} AS f, {_ZERO.format('shipped')} AS t FROM orders o JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""

YEAR_LABEL = "CASE WHEN {0} < 0 THEN -({0}) || ' BC' ELSE 'AD ' || {0} END"
RANGE_LABEL = (
    "CASE WHEN {0} = {1} THEN " + YEAR_LABEL.format("{0}") + " WHEN {0} < 0 AND {1} < 0 THEN -({0}) || ' – ' || -({1}) || ' BC' "
    "WHEN {0} > 0 AND {1} > 0 THEN 'AD ' || {0} || ' – ' || {1} ELSE -({0}) || ' BC' || ' – ' || 'AD ' || {1} END"
)
