"""Queries over laws of curated data; the star tables stand for the curated ones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import laws
from tessera.plans.registry import query
from tessera.sources.star import table

_WITNESS = """w AS (SELECT l_orderkey AS event, l_partkey AS n, l_suppkey % 7 AS book, CASE WHEN l_quantity >= 49 THEN NULL WHEN l_quantity < 3 THEN CAST([] AS BIGINT[]) ELSE [l_partkey % 40, l_suppkey % 40] END AS verses FROM lineitem WHERE l_linenumber < 4)"""


@query(f"""WITH {_WITNESS}, v AS (SELECT event, book, n, rid, unnest(list_distinct(verses)) AS verse FROM (SELECT *, row_number() OVER () AS rid FROM w)),
tops AS (SELECT DISTINCT o_orderkey AS event, o_custkey % 5 AS book FROM orders)
SELECT 'unknown-book' AS law, event || '/' || n AS subject FROM w WHERE book = 6
UNION ALL SELECT 'no-translation', event || '/' || n FROM w WHERE verses IS NULL
UNION ALL SELECT 'no-verse', event || '/' || n FROM w WHERE len(verses) = 0
UNION ALL SELECT 'common-verse', event || '/' || book FROM (SELECT DISTINCT event, book FROM (SELECT event, book, verse FROM v GROUP BY 1, 2, 3 HAVING count(*) > 1))
UNION ALL SELECT 'no-witness', event || '/' || book FROM tops t WHERE event IN (SELECT event FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE w.event = t.event AND w.book = t.book)""")
def witness_laws(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber < 4")
    verses = F.when(F.col("l_quantity") >= 49, None).when(F.col("l_quantity") < 3, F.array().cast("array<bigint>")).otherwise(F.array(F.col("l_partkey") % 40, F.col("l_suppkey") % 40))
    witnesses = lines.select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("n"), (F.col("l_suppkey") % 7).alias("book"), verses.alias("verses"))
    books = spark.range(6).select(F.col("id").alias("book"))
    tops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 5).alias("book"))
    return laws.witness_violations(witnesses, books, tops)


@query("""WITH e AS (SELECT p_partkey AS event, p_partkey AS pos, CASE WHEN p_size = 9 THEN NULL ELSE p_size * 10 END AS f, CASE WHEN p_size = 9 THEN NULL ELSE p_size * 10 + p_partkey % 30 END AS t FROM part)
SELECT event, b.boundary, CASE WHEN t <= b.year THEN 'before' ELSE 'after' END AS side FROM e, (VALUES ('exile', 200, 900), ('return', 350, 1500)) b(boundary, year, pos)
WHERE e.pos <> b.pos AND ((t <= b.year AND e.pos > b.pos) OR (f > b.year AND e.pos <= b.pos))""")
def boundary_order(spark, sf_dir):
    size = F.when(F.col("p_size") != 9, F.col("p_size") * 10)
    events = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event"), F.col("p_partkey").alias("pos"), size.alias("w_first"), (size + F.col("p_partkey") % 30).alias("w_last"))
    return laws.boundary_violations(events, [("exile", 200, 900), ("return", 350, 1500)])


_SPOTS = "p AS (SELECT s_suppkey AS id, 30 + s_suppkey % 50 / 200.0 AS lat, 35 + s_suppkey % 3 / 1000.0 AS lon FROM supplier)"


@query(f"""WITH {_SPOTS}, m AS (SELECT c_custkey % 120 AS survivor, c_custkey // 7 AS absorbed FROM customer)
SELECT law, survivor || '/' || absorbed AS subject FROM (SELECT 'no-survivor' AS law, * FROM m WHERE survivor NOT IN (SELECT id FROM p) UNION ALL
SELECT 'no-absorbed', * FROM m WHERE absorbed NOT IN (SELECT id FROM p) UNION ALL
SELECT 'too-far', survivor, absorbed FROM m JOIN p a ON a.id = survivor JOIN p b ON b.id = absorbed
WHERE acos(least(1.0, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)))) * 6371.0088 > 1.0)""")
def merge_laws(spark, sf_dir):
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (30 + F.col("s_suppkey") % 50 / 200.0).alias("lat"), (35 + F.col("s_suppkey") % 3 / 1000.0).alias("lon"))
    merges = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 120).alias("survivor"), F.floor(F.col("c_custkey") / 7).alias("absorbed"))
    return laws.merge_violations(merges, places)


@query("""WITH n AS (SELECT o_custkey AS place, CAST(o_orderkey AS VARCHAR) AS name, o_orderkey % 900 AS f, o_orderkey % 900 + o_custkey % 40 - 2 AS t, [o_orderkey % 2500, o_custkey] AS verses FROM orders)
SELECT 'unknown-place' AS law, place || '/' || name AS subject FROM n WHERE place % 11 = 0
UNION ALL SELECT 'years', place || '/' || name FROM n WHERE f < 5 OR t > 890 OR f > t
UNION ALL SELECT 'overlap', place || '/' || name FROM (SELECT *, max(t) OVER (PARTITION BY place ORDER BY f, t, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n) WHERE f <= reach
UNION ALL SELECT DISTINCT 'unknown-verse', place || '/' || name FROM (SELECT place, name, unnest(verses) AS v FROM n) WHERE v NOT IN (SELECT p_partkey FROM part)""")
def place_name_laws(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = F.col("o_orderkey") % 900
    names = orders.select(F.col("o_custkey").alias("place"), F.col("o_orderkey").cast("string").alias("name"), first.alias("from_year"), (first + F.col("o_custkey") % 40 - 2).alias("to_year"), F.array(F.col("o_orderkey") % 2500, F.col("o_custkey")).alias("verses"))
    places = orders.where("o_custkey % 11 <> 0").select(F.col("o_custkey").alias("place"))
    return laws.place_name_violations(names, places, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("verse")), 5, 890)


@query("""WITH a AS (SELECT p_size AS id, string_split(p_name, ' ')[1] AS name, [p_partkey, 1 + (p_partkey + 1) % 50] AS verses FROM part WHERE p_partkey <= 300),
own AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS own FROM part)
SELECT 'repeated' AS law, id || '/' || name AS subject FROM a GROUP BY id, name HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'own-name', a.id || '/' || a.name FROM a JOIN own ON own.id = a.id AND own.own = a.name
UNION ALL SELECT 'not-in-verse', id || '/' || name || '/' || verse FROM (SELECT id, name, unnest(verses) AS verse FROM a) LEFT JOIN part ON p_partkey = verse WHERE NOT coalesce(contains(p_name, name), false)""")
def alias_laws(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    # small ids stand for places: the aliases of the first parts
    aliases = part.where("p_partkey <= 300").select(F.col("p_size").alias("id"), word.alias("name"), F.array(F.col("p_partkey"), 1 + (F.col("p_partkey") + 1) % 50).alias("verses"))
    places = part.select(F.col("p_partkey").alias("id"), F.concat(word, F.lit(" (in the list)")).alias("name"))
    return laws.alias_violations(aliases, places, part.select(F.col("p_partkey").alias("verse"), F.col("p_name").alias("text")))


@query("""WITH i AS (SELECT l_suppkey % 40 AS part, l_partkey AS item, [l_orderkey % 50000] AS verses FROM lineitem), p AS (SELECT unnest(range(0, 60)) AS part)
SELECT 'repeated-item' AS law, CAST(item AS VARCHAR) AS subject FROM i GROUP BY item HAVING count(*) > 1
UNION ALL SELECT 'empty-part', CAST(part AS VARCHAR) FROM p WHERE part NOT IN (SELECT part FROM i)
UNION ALL SELECT 'no-verse', CAST(item AS VARCHAR) FROM i GROUP BY item HAVING count(*) FILTER (verses[1] IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)) = 0""")
def catechism_laws(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("part"), F.col("l_partkey").alias("item"), F.array(F.col("l_orderkey") % 50000).alias("verses"))
    verses = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("verse"))
    return laws.catechism_violations(spark.range(60).select(F.col("id").alias("part")), items, verses)


@query("SELECT l_partkey || '-' || l_suppkey AS edge_id, count(DISTINCT l_linenumber) AS n_spans FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1")
def span_laws(spark, sf_dir):
    edge = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return laws.span_violations(table(spark, sf_dir, "lineitem").select(edge.alias("edge_id"), F.col("l_linenumber").alias("span")))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) END NULLS FIRST, CASE WHEN o_orderstatus = 'O' THEN month(o_orderdate) END NULLS FIRST, o_orderkey) - 1 AS place FROM orders""")
def temporal_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")).alias("f"), F.when(F.col("o_orderstatus") == "O", F.month("o_orderdate")).alias("t"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*laws.temporal_key("f", "t", "o_orderkey"))) - 1
    return orders.select("o_orderkey", place.cast("long").alias("place"))


@query("SELECT l_orderkey AS succession, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def succession_join(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("succession"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("node"))
    return laws.succession_steps(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("succession")), steps)


@query("""SELECT o_orderkey, o_orderpriority, n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1) ON l_orderkey = o_orderkey""")
def keyed_attach(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines")).join(orders.select("o_orderkey"), "o_orderkey", "left_semi")
    return laws.attached(laws.united(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "o_orderkey"), counts, "o_orderkey")


_TOKENS = """t AS (SELECT p_partkey AS text_id, ord, 1 + coalesce(sum(length(w) + 1) OVER (PARTITION BY p_partkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS s, length(w) AS n
FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS ord FROM part))"""


@query(f"""WITH {_TOKENS}, e AS (SELECT text_id, ord, CAST(s AS INT) AS s, CAST(s + n AS INT) AS e FROM t), r AS (SELECT p_partkey AS text_id, 0 AS s, CAST(length(p_name) - p_partkey % 2 AS INT) AS e FROM part)
SELECT r.text_id, r.s AS start, r.e AS "end", CAST(CASE WHEN b.ord IS NOT NULL THEN a.ord END AS INT) AS first, CAST(CASE WHEN a.ord IS NOT NULL THEN b.ord END AS INT) AS last
FROM r LEFT JOIN e a ON a.text_id = r.text_id AND a.s = r.s LEFT JOIN e b ON b.text_id = r.text_id AND b.e = r.e""")
def words_covering(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))
    tokens = text.token_spans(part).select("text_id", F.explode("tokens").alias("t")).select("text_id", "t.ord", "t.start", "t.end")
    ranges = part.select("text_id", F.lit(0).alias("start"), (F.char_length("text") - F.col("text_id") % 2).cast("int").alias("end"))
    return laws.words_covering(tokens, ranges)


@query("SELECT o_orderkey, o_comment AS verses FROM (SELECT o_orderkey, o_orderpriority AS o_comment FROM orders)")
def translation_resolve(spark, sf_dir):
    named = F.create_map(F.lit("kjv"), F.col("o_orderpriority"), F.lit("esv"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", laws.resolved(named).alias("verses"))
