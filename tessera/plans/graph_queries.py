"""Queries over the typed graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dedupe, graph, sequence, xref
from tessera.plans.registry import query
from tessera.sources import star
from tessera.sources.star import INDEX_SQL, NODES_SQL, ROWS_SQL, table

#: Rows that a page query shows of each list.
PAGE = 5


@query(f"WITH {INDEX_SQL} SELECT position, rel, dir, count(DISTINCT edge_id) AS n_edges FROM idx GROUP BY 1, 2, 3")
def edge_summary(spark, sf_dir):
    return graph.edge_summary(star.index(spark, sf_dir))


@query(f"""WITH {INDEX_SQL}, firsts AS (
  SELECT position, rel, dir, edge_id, other, min((family, row_ord)) AS f FROM idx GROUP BY 1, 2, 3, 4, 5)
SELECT position, rel, dir, edge_id, other, place FROM (
  SELECT *, row_number() OVER (PARTITION BY position, rel, dir ORDER BY f, edge_id) - 1 AS place FROM firsts) WHERE place < {PAGE}""")
def edge_page(spark, sf_dir):
    page = graph.edge_page(star.index(spark, sf_dir), PAGE)
    return page.select("position", "rel", "dir", "edge_id", "other", F.col("place").cast("long").alias("place"))


@query(f"WITH {NODES_SQL} SELECT * FROM nodes ORDER BY id LIMIT 50 OFFSET 10")
def node_page(spark, sf_dir):
    return graph.node_page(star.nodes(spark, sf_dir), 50, 10)


@query(f"""WITH {NODES_SQL}, asked AS (SELECT CAST(o_orderkey AS BIGINT) AS place, CASE WHEN o_orderkey % 3 = 0 THEN 'Person:customer-' || o_custkey
  WHEN o_orderkey % 3 = 1 THEN 'Place:nation-' || o_orderkey ELSE 'Nothing:' || o_orderkey END AS id FROM orders WHERE o_orderkey < 200)
SELECT a.place, a.id, n.kind, n.label, n.kind IS NULL AS missing FROM asked a LEFT JOIN nodes n ON n.id = a.id""")
def elements(spark, sf_dir):
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(
        key.alias("place"),
        F.when(key % 3 == 0, F.concat(F.lit("Person:customer-"), "o_custkey")).when(key % 3 == 1, F.concat(F.lit("Place:nation-"), key)).otherwise(F.concat(F.lit("Nothing:"), key)).alias("id"),
    )
    return graph.elements(star.nodes(spark, sf_dir), asked).select("place", "id", "kind", "label", "missing")


@query(f"""WITH {INDEX_SQL}, {NODES_SQL} SELECT i.position, i.rel, i.dir, i.edge_id, i.row_ord, i.other, n.kind AS other_kind, n.label AS other_label
FROM idx i LEFT JOIN nodes n ON n.id = i.other""")
def edges_with_nodes(spark, sf_dir):
    found = graph.edges_with_nodes(star.index(spark, sf_dir), star.nodes(spark, sf_dir))
    return found.select("position", "rel", "dir", "edge_id", "row_ord", "other", "other_kind", "other_label")


@query(f"""WITH {INDEX_SQL} SELECT DISTINCT 'Place:nation-' || n_nationkey AS start, i.other AS position FROM nation JOIN idx i
ON i.position = 'Place:nation-' || n_nationkey AND i.rel = 'LocatedAt' AND i.dir = 'inverse'""")
def step(spark, sf_dir):
    place = F.concat(F.lit("Place:nation-"), "n_nationkey")
    start = table(spark, sf_dir, "nation").select(place.alias("start"), place.alias("position"))
    return graph.step(start, star.index(spark, sf_dir), "LocatedAt", "inverse")


@query(f"""WITH {INDEX_SQL} SELECT DISTINCT 'Person:customer-' || c_custkey AS start, b.other AS position FROM customer
JOIN idx a ON a.position = 'Person:customer-' || c_custkey AND a.rel = 'Participates' AND a.dir = 'forward'
JOIN idx b ON b.position = a.other AND b.rel = 'Succession' AND b.dir = 'forward'""")
def path_two_hop(spark, sf_dir):
    person = F.concat(F.lit("Person:customer-"), "c_custkey")
    start = table(spark, sf_dir, "customer").select(person.alias("start"), person.alias("position"))
    return graph.path(start, star.index(spark, sf_dir), ("Participates", "forward"), ("Succession", "forward"))


@query(f"""WITH {INDEX_SQL}, d AS (SELECT DISTINCT position, other, rel, dir, edge_id FROM idx)
SELECT rel, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_gaps FROM d GROUP BY 1""")
def inverse_bijection(spark, sf_dir):
    index = star.index(spark, sf_dir)
    entries = index.select("position", "other", "rel", "dir", "edge_id").distinct().groupBy("rel").agg(F.count(F.lit(1)).alias("n_entries"))
    gaps = graph.inverse_gaps(index).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    return entries.join(gaps, "rel", "left").select("rel", "n_entries", F.coalesce("n", F.lit(0)).cast("long").alias("n_gaps"))


@query(f"""WITH {ROWS_SQL}, b AS (SELECT edge_id, count(*) AS n_rows, min((family, row_ord)) AS f FROM rows_ GROUP BY 1)
SELECT edge_id, n_rows, CAST(f[1] AS INT) AS first_family, CAST(f[2] AS BIGINT) AS first_ord FROM b""")
def rows_behind(spark, sf_dir):
    return graph.rows_behind(star.rows(spark, sf_dir))


@query(f"WITH {ROWS_SQL} SELECT DISTINCT edge_id, rel, subject, object FROM rows_")
def edge_id_hash(spark, sf_dir):
    return star.rows(spark, sf_dir).select("edge_id", "rel", "subject", "object").distinct()


@query(f"WITH {INDEX_SQL} SELECT position, other, edge_id FROM idx WHERE dir = 'both'")
def symmetric_edges(spark, sf_dir):
    return star.index(spark, sf_dir).where("dir = 'both'").select("position", "other", "edge_id")


@query(f"WITH {INDEX_SQL}, {NODES_SQL} SELECT kind, count(*) AS n_positions FROM (SELECT DISTINCT id, split_part(id, ':', 1) AS kind FROM (SELECT id FROM nodes UNION ALL SELECT position FROM idx)) GROUP BY 1")
def position_inventory(spark, sf_dir):
    from tessera.model import kind_of

    found = graph.positions(star.nodes(spark, sf_dir), star.index(spark, sf_dir))
    return found.groupBy(kind_of(F.col("position")).alias("kind")).agg(F.count(F.lit(1)).alias("n_positions"))


@query(f"""WITH {ROWS_SQL} SELECT family, string_agg(provenance, ',' ORDER BY provenance) AS provenances FROM (SELECT DISTINCT family, provenance FROM rows_) GROUP BY 1""")
def provenance_set(spark, sf_dir):
    return graph.provenance_sets(star.rows(spark, sf_dir), "family")


@query(f"""WITH {ROWS_SQL}, {NODES_SQL}, known AS (SELECT id FROM nodes WHERE id NOT LIKE '%7')
SELECT rel, side, position, count(*) AS n_rows FROM (SELECT rel, 'subject' AS side, subject AS position FROM rows_ UNION ALL SELECT rel, 'object', object FROM rows_)
WHERE position NOT IN (SELECT id FROM known) GROUP BY 1, 2, 3""")
def dangling_refs(spark, sf_dir):
    known = star.nodes(spark, sf_dir).where("id not like '%7'")
    return graph.dangling(star.rows(spark, sf_dir), known)


@query(f"""WITH {ROWS_SQL} SELECT object AS child, count(DISTINCT subject) AS n_parents FROM (
  SELECT rel, subject, object FROM rows_ WHERE rel = 'Contains' UNION ALL
  SELECT 'Contains', 'Container:region-0', 'Place:nation-' || n_nationkey FROM nation WHERE n_nationkey % 4 = 1) GROUP BY 1 HAVING count(DISTINCT subject) > 1""")
def forest_violations(spark, sf_dir):
    extra = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 1").select(
        F.lit("Contains").alias("rel"), F.lit("Container:region-0").alias("subject"), F.concat(F.lit("Place:nation-"), "n_nationkey").alias("object")
    )
    return graph.many_parents(star.rows(spark, sf_dir).select("rel", "subject", "object").unionByName(extra))


_CHAIN = "SELECT event_id AS parent, event_id + 1 AS child FROM events WHERE event_id % 8 < 7"


@query(f"""WITH RECURSIVE e AS ({_CHAIN}), c AS (SELECT parent AS ancestor, child AS descendant, 1 AS steps FROM e
  UNION ALL SELECT c.ancestor, e.child, c.steps + 1 FROM c JOIN e ON e.parent = c.descendant WHERE c.steps < 8)
SELECT ancestor, descendant, CAST(min(steps) AS INT) AS steps FROM c GROUP BY 1, 2""")
def acyclic_closure(spark, sf_dir):
    chain = table(spark, sf_dir, "events").where("event_id % 8 < 7").select(F.col("event_id").alias("parent"), (F.col("event_id") + 1).alias("child"))
    return graph.closure(chain, 8)


_RINGS = "SELECT event_id AS parent, CASE WHEN event_id % 100 = 99 THEN event_id - 99 ELSE event_id + 1 END AS child FROM events"


@query(f"""WITH e AS ({_RINGS}) SELECT parent AS node FROM e WHERE parent // 100 IN (SELECT parent // 100 FROM e GROUP BY 1 HAVING count(*) = 100)""")
def cycle_nodes(spark, sf_dir):
    """All events in rings of a hundred; a last, shorter run is a chain."""
    event = F.col("event_id")
    ring = table(spark, sf_dir, "events").select(event.alias("parent"), F.when(event % 100 == 99, event - 99).otherwise(event + 1).alias("child"))
    return graph.cycles(ring)


_LINES = "SELECT l_suppkey % 20 AS parent, 1000 + l_partkey % 60 AS child FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 1000 + n_nationkey, 1000 + (n_nationkey + 1) % 25 FROM nation"


@query(f"""WITH e AS ({_LINES}) SELECT 'repeated' AS law, child AS node FROM (SELECT DISTINCT child FROM (SELECT parent, child FROM e GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'parents', child FROM e GROUP BY child HAVING count(DISTINCT parent) > 1 UNION ALL SELECT 'cycle', 1000 + n_nationkey FROM nation""")
def forest_laws(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 20).alias("parent"), (1000 + F.col("l_partkey") % 60).alias("child"))
    ring = table(spark, sf_dir, "nation").select((1000 + F.col("n_nationkey")).cast("long").alias("parent"), (1000 + (F.col("n_nationkey") + 1) % 25).cast("long").alias("child"))
    return graph.forest_laws(lines.unionByName(ring))


@query("""SELECT 'nation-' || a.n_nationkey AS child, 'nation-' || b.n_nationkey AS sibling FROM nation a JOIN nation b
ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def siblings(spark, sf_dir):
    parents = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.concat(F.lit("nation-"), "n_nationkey").alias("child"))
    return graph.siblings(parents)


@query("""SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier""")
def components(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    edges = sequence.steps(suppliers, ["s_nationkey"], "s_suppkey", ["s_suppkey"]).select(F.col("prior").alias("a"), F.col("next").alias("b"))
    return graph.components(edges, suppliers.select(F.col("s_suppkey").alias("node")))


@query(f"""WITH {star.CITES_SQL}, s AS (SELECT from_part, to_part, CAST(sum(votes) AS BIGINT) AS votes, min(o_key) AS seen FROM cites GROUP BY 1, 2)
SELECT from_part, to_part, votes, p_name AS preview, rank FROM (SELECT s.*, p_name, row_number() OVER (PARTITION BY from_part ORDER BY votes DESC, seen, to_part) AS rank
FROM s JOIN part ON p_partkey = to_part WHERE p_size <> 7) WHERE rank <= 20""")
def xref_top20(spark, sf_dir):
    previews = table(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("to_part"), F.col("p_name").alias("preview"))
    found = xref.top_targets(star.citations(spark, sf_dir), "from_part", "to_part", "o_key", previews)
    return found.select("from_part", "to_part", "votes", "preview", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_suppkey AS span, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY first, l_partkey) - 1 AS place FROM (
SELECT l_suppkey, l_partkey, min((l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1, 2)""")
def items_for_span(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("span"), F.col("l_partkey").alias("item"), "l_orderkey", "l_linenumber")
    found = xref.first_seen(lines, ["item"], ["span"], ["l_orderkey", "l_linenumber"])
    return found.select("span", "item", F.col("place").cast("long").alias("place"))


@query("""SELECT o_custkey AS owner, o_orderpriority AS account, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS verses,
row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) - 1 AS place FROM orders GROUP BY 1, 2""")
def accounts_by_first_seen(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("account"), "o_orderkey")
    seen = xref.first_seen(orders, ["account"], ["owner"], ["o_orderkey"])
    verses = orders.groupBy("owner", "account").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("verses"))
    return verses.join(seen, ["owner", "account"]).select("owner", "account", "verses", F.col("place").cast("long").alias("place"))


_MERGES = "SELECT s_suppkey AS absorbed, s_suppkey - 1 AS survivor FROM supplier WHERE s_suppkey % 10 = 9"


@query(f"""WITH m AS ({_MERGES}) SELECT coalesce(survivor, l_suppkey) AS supplier, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts
FROM lineitem LEFT JOIN m ON absorbed = l_suppkey GROUP BY 1""")
def merge_repoint(spark, sf_dir):
    merges = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 9").select(F.col("s_suppkey").alias("absorbed"), (F.col("s_suppkey") - 1).alias("survivor"))
    lines = dedupe.repoint(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", merges)
    return lines.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"))


@query("""WITH a AS (SELECT p_name AS k, min(p_brand) AS v FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1),
b AS (SELECT p_type AS k, min(p_brand) AS v FROM part WHERE p_size < 3 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1)
SELECT p_partkey, coalesce(a.v, b.v) AS brand, CAST(CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 ELSE 0 END AS INT) AS tier
FROM part LEFT JOIN a ON a.k = p_name LEFT JOIN b ON b.k = p_type""")
def tiered_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tiers = [("p_name", part.select("p_name", F.col("p_brand").alias("brand"))), ("p_type", part.where("p_size < 3").select("p_type", F.col("p_brand").alias("brand")))]
    return dedupe.tiered(part.select("p_partkey", "p_name", "p_type"), tiers, "brand").select("p_partkey", "brand", "tier")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS i, l_orderkey AS e FROM lineitem)
SELECT a.i AS a, b.i AS b, count(*) AS n_common FROM s a JOIN s b ON a.e = b.e AND a.i < b.i GROUP BY 1, 2""")
def pair_collision(spark, sf_dir):
    return dedupe.shared_counts(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS i, CAST(year(o_orderdate) AS VARCHAR) || o_orderpriority AS e FROM orders), n AS (SELECT i, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.i AS a, b.i AS b, count(*) AS common FROM s a JOIN s b ON a.e = b.e AND a.i < b.i GROUP BY 1, 2)
SELECT a, b, common, round(likeness, 9) AS likeness FROM (SELECT a, b, common, common / (x.n + y.n - common) AS likeness FROM p JOIN n x ON x.i = a JOIN n y ON y.i = b) WHERE likeness >= 0.5""")
def jaccard_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.year("o_orderdate").cast("string"), "o_orderpriority").alias("e"))
    # As round(likeness, 9), which makes a decimal of each double and took most of the time of hundreds of millions of pairs.
    return dedupe.set_pairs(orders, "o_custkey", "e", 0.5).withColumn("likeness", F.floor(F.col("likeness") * 1e9 + 0.5) / F.lit(1e9))


@query("""SELECT DISTINCT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND a.o_orderpriority = b.o_orderpriority AND year(a.o_orderdate) = year(b.o_orderdate)""")
def dedupe_blocked(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    rule = (F.col("a.o_orderpriority") == F.col("b.o_orderpriority")) & (F.col("a.y") == F.col("b.y"))
    return dedupe.blocked_pairs(orders, "o_orderkey", "o_custkey", rule)


@query("""SELECT o_custkey AS owner, count(*) AS n_orders, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_done, min(o_orderkey) AS first_id,
round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS percent_done FROM orders GROUP BY 1""")
def coverage_ratios(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    n = F.count(F.lit(1))
    share = F.when(n == 0, F.lit(0.0)).otherwise(100.0 * done / n)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(n.alias("n_orders"), done.alias("n_done"), F.min("o_orderkey").alias("first_id"), F.round(share, 6).alias("percent_done"))


@query("SELECT p_brand AS slug, count(DISTINCT p_partkey) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def slug_collisions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("slug")).agg(F.count_distinct("p_partkey").alias("n"), F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("ids")).where("n > 1")


@query("""SELECT s_name AS label, 'supplier' AS kind FROM supplier WHERE contains(lower(s_name), '#00000001') UNION ALL
SELECT p_name, 'part' FROM part WHERE contains(lower(p_name), 'a')""")
def label_search(spark, sf_dir):
    """Case-insensitive search for a part of a label over several kinds."""
    find = lambda df, column, kind, term: df.where(F.contains(F.lower(column), F.lit(term.lower()))).select(F.col(column).alias("label"), F.lit(kind).alias("kind"))
    return find(table(spark, sf_dir, "supplier"), "s_name", "supplier", "#00000001").unionByName(find(table(spark, sf_dir, "part"), "p_name", "part", "A"))


@query("""SELECT key, CAST(max(CASE WHEN source = 2 THEN value END) IS NOT NULL AS INT) AS curated, coalesce(max(CASE WHEN source = 2 THEN value END), max(CASE WHEN source = 1 THEN value END)) AS value
FROM (SELECT c_custkey AS key, 1 AS source, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 2, 'CURATED' FROM customer WHERE c_custkey % 6 = 0) GROUP BY 1""")
def override_latest(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    base = customer.select(F.col("c_custkey").alias("key"), F.lit(1).alias("source"), F.col("c_mktsegment").alias("value"))
    curated = customer.where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("key"), F.lit(2).alias("source"), F.lit("CURATED").alias("value"))
    won = sequence.latest(base.unionByName(curated), "key", [F.desc("source")])
    return won.select("key", (F.col("source") == 2).cast("int").alias("curated"), "value")
