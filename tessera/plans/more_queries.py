"""Queries for the remaining operators: codecs, spans, joins, records, exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import model
from tessera.functions import geo, refs, text, timeline
from tessera.operators import dedupe, graph, reading, records, scene, sequence
from tessera.plans.registry import query
from tessera.query import GraphTables
from tessera.sources import sections, star
from tessera.sources.star import EVENTS_SQL, NODES_SQL, ROWS_SQL, table


@query(f"WITH {NODES_SQL} SELECT id, split_part(id, ':', 1) AS kind, substr(id, strpos(id, ':') + 1) AS raw, substr(sha256(kind || chr(10) || id), 1, 32) AS pid FROM nodes")
def position_codec(spark, sf_dir):
    node = F.col("id")
    return star.nodes(spark, sf_dir).select(node, model.kind_of(node).alias("kind"), model.raw_of(node).alias("raw"), model.content_hash(F.col("kind"), node).alias("pid"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' AS json FROM part""")
def canonical_json(spark, sf_dir):
    row = F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(row).alias("json"))


@query("""WITH p AS (SELECT n_nationkey AS place, n_nationkey * 0.01 + 8 AS lat, n_nationkey * 0.02 - 8 AS lon FROM nation)
SELECT a.place AS a, b.place AS b, round(111.32 * sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(b.lat - a.lat, 2)), 4) AS km FROM p a JOIN p b ON b.place = a.place + 1""")
def flat_distance(spark, sf_dir):
    k = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select(k.alias("place"), (k * 0.01 + 8).alias("lat"), (k * 0.02 - 8).alias("lon"))
    a, b = p.alias("a"), p.alias("b")
    km = geo.flat_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("b.place") == F.col("a.place") + 1).select(F.col("a.place").alias("a"), F.col("b.place").alias("b"), F.round(km, 4).alias("km"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE NOT (l_linenumber >= 2 AND l_linenumber + l_quantity <= 20) GROUP BY 1, 2")
def target_outside_span(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    inside = refs.within(F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity"), F.lit(2), F.lit(20))
    return lines.where(~inside).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


_PLACES = "t AS (SELECT c_custkey AS k, 'In ' || r_name || 's and ' || r_name || ', ' || n_name AS t, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {_PLACES} SELECT k, r_name AS name, CAST(3 + length(r_name) + 6 AS INT) AS start FROM t")
def mention_spans(spark, sf_dir):
    """Region names in a sentence; a name that runs on into letters is none."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    met = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    prose = met.select(F.col("c_custkey").alias("k"), F.concat(F.lit("In "), "r_name", F.lit("s and "), "r_name", F.lit(", "), "n_name").alias("text"))
    names = [(n, "place", n) for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]

    def run(frames):
        for frame in frames:
            found = [(k, name, start) for k, t in zip(frame["k"], frame["text"]) for name, _, start, _ in text.name_spans(t, names)]
            yield pd.DataFrame(found, columns=["k", "name", "start"])

    return prose.mapInPandas(run, "k long, name string, start int")


@query("""SELECT c_custkey AS k, 'AB[' || substr(c_name, 1, 3) || ']' || substr(c_name, 4) || '[' || c_mktsegment || ']' AS marked FROM customer""")
def span_bracketing(spark, sf_dir):
    line = F.concat(F.lit("AB"), "c_name", "c_mktsegment")
    n = F.char_length("c_name") + 2
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")), F.struct(n.alias("start"), (n + F.char_length("c_mktsegment")).alias("end")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.bracketed(line, spans).alias("marked"))


@query("""SELECT c_custkey AS k, 'case' AS how, CAST(2 AS INT) AS start FROM customer UNION ALL SELECT c_custkey, 'exact', CAST(2 + length(c_name) + 1 AS INT) FROM customer UNION ALL SELECT c_custkey, 'missing', -1 FROM customer""")
def span_alignment(spark, sf_dir):
    line = F.concat(F.lit("AB"), "c_name", F.lit(" "), "c_mktsegment")
    found = text.aligned_spans(line, F.array(F.lower("c_name"), F.col("c_mktsegment"), F.lit("absent")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(found).alias("x")).select("k", "x.how", "x.start")


@query("""SELECT o_orderpriority AS edition, count(*) AS n_units, count(*) FILTER (o_orderstatus <> 'F') AS n_different, min(o_orderkey) FILTER (o_orderstatus <> 'F') AS example FROM orders GROUP BY 1""")
def text_diff(spark, sf_dir):
    other = F.col("o_orderstatus") != "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("edition")).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(other).alias("n_different"), F.min(F.when(other, F.col("o_orderkey"))).alias("example"))


@query(f"WITH {EVENTS_SQL} SELECT place, min(event) AS event FROM ev WHERE from_year <= -2 AND to_year >= -1 GROUP BY 1")
def containment_join(spark, sf_dir):
    """The first event of each place whose span contains a range."""
    holds = star.events(spark, sf_dir).where((F.col("from_year") <= -2) & (F.col("to_year") >= -1))
    return holds.groupBy("place").agg(F.min("event").alias("event"))


@query("""WITH f AS (SELECT lower(p_brand) AS k, min(p_partkey) AS first_id FROM part GROUP BY 1) SELECT p_partkey, first_id FROM part JOIN f ON k = lower(p_brand)""")
def name_join_first(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = graph.lookup_first(part.select(F.lower("p_brand").alias("k"), F.col("p_partkey").alias("first_id")), "k", ["first_id"])
    return part.withColumn("k", F.lower("p_brand")).join(first, "k").select("p_partkey", "first_id")


@query("SELECT o_custkey AS place, string_agg(y, ',' ORDER BY y) AS refs FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) GROUP BY 1")
def attestation_set(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("place")).agg(F.array_join(F.sort_array(F.collect_set(y)), ",").alias("refs"))


@query("SELECT l_returnflag AS flag, count(*) FILTER (l_tax = 0) AS untaxed, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity < 10 AND l_tax > 0) AS small FROM lineitem GROUP BY 1")
def bucket_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if((F.col("l_quantity") < 10) & (F.col("l_tax") > 0)).alias("small")
    )


_ATTESTS = "a AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS verse FROM lineitem), c AS (SELECT o_orderkey AS event, o_orderkey % 200 + 1 AS verse FROM orders)"


@query(f"WITH {_ATTESTS} SELECT event, count(*) AS n_left FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.event = a.event AND c.verse = a.verse) GROUP BY 1")
def attestation_correction(spark, sf_dir):
    attests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("verse")).distinct()
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_orderkey") % 200 + 1).alias("verse"))
    return records.corrected(attests, listed)[0].groupBy("event").agg(F.count(F.lit(1)).alias("n_left"))


@query(f"""WITH {ROWS_SQL}, g AS (SELECT edge_id, unnest(['Source:a', 'Anchor:' || row_ord]) AS ground FROM (SELECT DISTINCT edge_id, row_ord FROM rows_ WHERE rel = 'LocatedAt'))
SELECT 'JustifiedBy' AS rel, edge_id AS subject, ground AS object, row_number() OVER (PARTITION BY edge_id ORDER BY ground) AS row_ord FROM g""")
def justified_by(spark, sf_dir):
    """Edges as subjects of further edges."""
    edges = star.rows(spark, sf_dir).where("rel = 'LocatedAt'").select("edge_id", "row_ord").distinct()
    grounds = edges.select("edge_id", F.explode(F.array(F.lit("Source:a"), F.concat(F.lit("Anchor:"), F.col("row_ord").cast("string")))).alias("ground"))
    return records.justified_by(grounds, ["ground"])


_LABELS = "CASE rel WHEN 'Contains' THEN 'contains' WHEN 'LocatedAt' THEN 'located-at' WHEN 'Participates' THEN 'participates-in' WHEN 'Succession' THEN 'follows-in' WHEN 'Cites' THEN 'cites' ELSE 'analogous-to' END"


@query(f"""WITH {ROWS_SQL}, {NODES_SQL} SELECT e.edge_id, coalesce(s.label, subject) || ' · ' || {_LABELS} || ' · ' || coalesce(o.label, object) AS label
FROM (SELECT DISTINCT edge_id, rel, subject, object FROM rows_) e LEFT JOIN nodes s ON s.id = subject LEFT JOIN nodes o ON o.id = object""")
def edge_labels(spark, sf_dir):
    return records.edge_labels(star.rows(spark, sf_dir), star.nodes(spark, sf_dir), model.edge_kinds(spark))


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS owner, l_orderkey // 8 AS c, l_orderkey % 8 + 1 AS v FROM lineitem),
g AS (SELECT *, CASE WHEN lag(v) OVER w + 1 = v AND lag(c) OVER w = c THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY owner ORDER BY c, v)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY owner ORDER BY c, v) AS run FROM g), s AS (SELECT owner, run, min(c) AS c, min(v) AS a, max(v) AS b FROM r GROUP BY 1, 2),
p AS (SELECT owner, c, a, CASE WHEN lag(c) OVER (PARTITION BY owner ORDER BY c, a) = c THEN '' ELSE c || '.' END || a || CASE WHEN b > a THEN '-' || b ELSE '' END AS part FROM s)
SELECT owner, string_agg(part, ', ' ORDER BY c, a) AS reference FROM p GROUP BY 1""")
def citation_text(spark, sf_dir):
    k = F.col("l_orderkey")
    verses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.expr("l_orderkey div 8").alias("chapter"), (k % 8 + 1).alias("verse"))
    return records.reference_runs(verses, ["owner"])


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS owner, l_orderkey // 8 AS c, l_orderkey % 8 + 1 AS v FROM lineitem),
g AS (SELECT *, v - row_number() OVER (PARTITION BY owner, c ORDER BY v) AS run FROM v)
SELECT owner, c AS from_chapter, min(v) AS from_verse, max(v) AS to_verse, count(*) AS n_verses FROM g GROUP BY owner, c, run HAVING count(*) >= 2""")
def passage_grouping(spark, sf_dir):
    k = F.col("l_orderkey")
    verses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.expr("l_orderkey div 8").alias("chapter"), (k % 8 + 1).alias("verse"))
    return reading.passages(reading.runs(verses, ["owner"])).select("owner", "from_chapter", "from_verse", "to_verse", "n_verses")


@query("""SELECT o_custkey AS parent, o_orderstatus AS parentage, count(*) AS n, string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS children FROM orders GROUP BY 1, 2""")
def kin_groups(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("parentage"), F.col("o_orderkey").cast("string").alias("child"))
    return records.kin_groups(parents).withColumn("children", F.array_join("children", ","))


@query(f"""WITH {ROWS_SQL}, {EVENTS_SQL}, p AS (SELECT subject AS id, string_agg(object, ',' ORDER BY family, row_ord) AS places FROM rows_ WHERE rel = 'LocatedAt' GROUP BY 1)
SELECT p.id, places, CAST(CASE WHEN event % 5 = 0 THEN -4004 ELSE from_year END AS INT) AS from_year, CAST(CASE WHEN event % 5 = 0 THEN 100 ELSE to_year END AS INT) AS to_year FROM p JOIN ev ON p.id = 'Event:order-' || event""")
def event_records(spark, sf_dir):
    """Events put together from their rows; a fifth of them has no date."""
    years = star.events(spark, sf_dir).where("event % 5 <> 0").select(F.concat(F.lit("Event:order-"), "event").alias("id"), "from_year", "to_year")
    payload = star.nodes(spark, sf_dir).where("kind = 'Event'").select("id")
    found = records.events(payload, star.rows(spark, sf_dir), years)
    return found.select("id", F.array_join("places", ",").alias("places"), F.col("from_year").cast("int").alias("from_year"), F.col("to_year").cast("int").alias("to_year"))


_SPINE = "sp AS (SELECT conv_id AS chapter, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord FROM conversations)"


@query(f"""WITH {_SPINE}, c AS (SELECT r_regionkey * 20 AS a, r_regionkey * 20 + 5 AS b, r_regionkey AS seq, r_name AS text FROM region)
SELECT ord, CAST(-1 AS BIGINT) AS seq, 'text' AS kind, text FROM sp UNION ALL SELECT ord, CAST(seq AS BIGINT), 'comment', c.text FROM sp JOIN c ON ord BETWEEN a AND b""")
def interleaved_view(spark, sf_dir):
    k = F.col("r_regionkey")
    comments = table(spark, sf_dir, "region").select((k * 20).alias("first"), (k * 20 + 5).alias("last"), k.alias("seq"), F.col("r_name").alias("text"))
    units = reading.spine(star.spine(spark, sf_dir)).select("ord", "text")
    return records.interleaved(units, F.broadcast(comments)).select("ord", "seq", "kind", "text")


@query("""SELECT CASE WHEN doc_id % 4 = 3 THEN 'uncovered' WHEN doc_id % 4 = 0 THEN 'exact' WHEN doc_id % 4 = 1 THEN 'case' ELSE 'mismatch' END AS tier, count(*) AS n FROM (SELECT c_custkey AS doc_id FROM customer) GROUP BY 1""")
def conservation_check(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    k = F.col("unit") % 4
    shown = F.when(k == 1, F.upper("text")).when(k == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    fragments = units.where(k != 3).select("unit", F.posexplode(F.split(shown, " ")).alias("ord", "text"))
    return records.conservation(units, fragments).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, '{"id":' || n_nationkey || ',"name":"' || n_name || '","verses":["' || coalesce(string_agg(DISTINCT o_orderpriority, '","' ORDER BY o_orderpriority), '') || '"]}' AS json
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name""")
def place_export(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    attests = orders.select(F.col("c_nationkey").cast("long").alias("place"), F.col("o_orderpriority").alias("verse"))
    return records.denormalised(nation.join(attests.select(F.col("place").alias("id")).distinct(), "id", "left_semi"), attests)


@query("SELECT CAST(k AS VARCHAR) AS path, CASE k % 6 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Truncated' WHEN 2 THEN 'Changed' WHEN 3 THEN 'LinkAdded' WHEN 4 THEN 'Extra' END AS problem FROM (SELECT p_partkey AS k FROM part) WHERE k % 6 <> 5")
def section_drift(spark, sf_dir):
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(k, k.cast("string").alias("path"), F.sha2("p_name", 256).alias("hash"), F.col("p_size").cast("long").alias("bytes"), F.lit(False).alias("link"))
    old = files.where(k % 6 != 4)
    new = files.where(k % 6 != 0).withColumns({
        "hash": F.when((k % 6).isin(1, 2), F.lit("other")).otherwise(F.col("hash")), "bytes": F.when(k % 6 == 1, F.col("bytes") - 1).otherwise(F.col("bytes")), "link": k % 6 == 3,
    })
    columns = ("path", "hash", "bytes", "link")
    return sections.drift(old.select(*columns), new.select(*columns))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT r_regionkey AS era, CAST(r_regionkey * 2 - 6 AS INT) AS a, CAST(r_regionkey * 2 - 5 AS INT) AS b FROM region)
SELECT DISTINCT CAST(era AS INT) AS era, narrative AS place FROM ev JOIN e ON from_year <= b AND a <= to_year""")
def map_per_era(spark, sf_dir):
    k = F.col("r_regionkey")
    eras = table(spark, sf_dir, "region").select(k.cast("int").alias("era"), (k * 2 - 6).cast("int").alias("from_year"), (k * 2 - 5).cast("int").alias("to_year"))
    events = star.events(spark, sf_dir).withColumn("place", F.col("narrative"))
    return GraphTables(spark, star.nodes(spark, sf_dir), star.rows(spark, sf_dir), events=events, eras=eras).map_of_eras()


@query(f"WITH {EVENTS_SQL} SELECT event, CASE WHEN event % 3 = 0 THEN y WHEN event % 3 = 1 THEN CASE WHEN i + 7 >= 0 THEN i + 8 ELSE i + 7 END END AS year FROM (SELECT event, CAST(from_year AS INT) AS y, CAST(CASE WHEN from_year > 0 THEN from_year - 1 ELSE from_year END AS INT) AS i FROM ev)")
def placement_resolve(spark, sf_dir):
    """An anchor with no offset, an eighth year of a reign, or an era alone."""
    y, k = F.col("from_year"), F.col("event") % 3
    none = F.lit(None).cast("int")
    year = sequence.resolve(F.when(k == 0, y), F.lit(0), F.when(k == 1, y), F.lit(8), none, none)
    return star.events(spark, sf_dir).select("event", year.cast("int").alias("year"))


@query("SELECT conv_id AS chapter, turn AS verse, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 2)) AND (conv_id < 20 OR (conv_id = 20 AND turn <= 1))")
def range_slice(spark, sf_dir):
    """Units between two loci; structs compare as the loci do."""
    at = F.struct("chapter", "verse")
    edge = lambda c, v: F.struct(F.lit(c).cast("long").alias("chapter"), F.lit(v).cast("long").alias("verse"))
    units = star.spine(spark, sf_dir).where((at >= edge(3, 2)) & (at <= edge(20, 1)))
    return units.select("chapter", "verse", F.count(F.lit(1)).over(Window.partitionBy("chapter")).alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT a.event AS a, b.event AS b FROM ev a JOIN ev b ON a.place = b.place AND a.narrative = b.narrative AND a.event < b.event AND a.from_year <= b.to_year AND b.from_year <= a.to_year")
def same_episode(spark, sf_dir):
    """Pairs of one narrative and place whose ranges meet, blocked by narrative."""
    meets = timeline.intersects(F.col("a.from_year"), F.col("a.to_year"), F.col("b.from_year"), F.col("b.to_year"))
    return dedupe.blocked_pairs(star.events(spark, sf_dir), "event", "narrative", meets & (F.col("a.place") == F.col("b.place")))


@query(f"WITH {EVENTS_SQL} SELECT place, count(DISTINCT narrative) AS n_narratives, min(from_year) AS first_year FROM ev WHERE from_year <= 1 AND 1 <= to_year GROUP BY 1")
def scene_single_year(spark, sf_dir):
    found = scene.in_window(star.events(spark, sf_dir), 1, 1)
    return found.groupBy("place").agg(F.count_distinct("narrative").alias("n_narratives"), F.min("from_year").alias("first_year"))
