"""Queries over time: ranges, labels, names over time, scenes, sequences, laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo, timeline
from tessera.operators import rules, scene, sequence
from tessera.plans.registry import query
from tessera.sources import star
from tessera.sources.star import EVENTS_SQL, RANGE_LABEL, YEAR_LABEL, table

#: The window of the scene queries, in zero-less years.
FIRST, LAST = -2, 1
_IN = f"from_year <= {LAST} AND {FIRST} <= to_year"
_IDX = "CASE WHEN {0} > 0 THEN {0} - 1 ELSE {0} END"
_YEAR = "CASE WHEN ({0}) >= 0 THEN ({0}) + 1 ELSE ({0}) END"


@query(f"WITH {EVENTS_SQL} SELECT event, from_year, to_year FROM ev WHERE {_IN}")
def range_overlap(spark, sf_dir):
    return scene.in_window(star.events(spark, sf_dir), FIRST, LAST).select("event", "from_year", "to_year")


@query(f"WITH {EVENTS_SQL} SELECT event, from_year, {YEAR_LABEL.format('from_year')} AS label, CAST({_IDX.format('from_year')} AS INT) AS idx, CAST(CASE WHEN from_year = -1 THEN 1 ELSE from_year + 1 END AS INT) AS next FROM ev")
def year_label(spark, sf_dir):
    y = F.col("from_year")
    return star.events(spark, sf_dir).select("event", "from_year", timeline.year_label(y).alias("label"), timeline.year_index(y).alias("idx"), timeline.next_year(y).alias("next"))


@query(f"""WITH {EVENTS_SQL} SELECT event, {RANGE_LABEL.format('from_year', 'to_year')} AS label,
CASE WHEN event % 3 = 0 THEN 'c. ' ELSE '' END || {RANGE_LABEL.format('from_year', 'to_year')} AS claim FROM ev""")
def range_label(spark, sf_dir):
    a, b = F.col("from_year"), F.col("to_year")
    note = F.when(F.col("event") % 3 == 0, F.lit("noted"))
    return star.events(spark, sf_dir).select("event", timeline.range_label(a, b).alias("label"), timeline.claim_label(a, b, note).alias("claim"))


@query(f"WITH {EVENTS_SQL}, m AS (SELECT event, floor(({_IDX.format('from_year')} + {_IDX.format('to_year')}) / 2.0) AS i FROM ev) SELECT event, CAST({_YEAR.format('i')} AS INT) AS middle FROM m")
def window_midpoint(spark, sf_dir):
    return star.events(spark, sf_dir).select("event", timeline.midpoint(F.col("from_year"), F.col("to_year")).cast("int").alias("middle"))


_PLACES = "p AS (SELECT place, min(from_year) AS a, max(to_year) AS b, min(event) AS e FROM ev GROUP BY 1)"
_BOUNDS = f"""{_PLACES}, x AS (SELECT place, CAST(CASE WHEN place % 2 = 0 THEN least(-1, a) END AS INT) AS exist_from, CAST(CASE WHEN place % 3 = 0 THEN greatest(1, b) END AS INT) AS exist_to FROM p)"""


def _bounds(spark, sf_dir):
    places = star.events(spark, sf_dir).groupBy("place").agg(F.min("from_year").alias("a"), F.max("to_year").alias("b"))
    first, last = timeline.existence(F.when(F.col("place") % 2 == 0, -1), F.when(F.col("place") % 3 == 0, 1), F.col("a"), F.col("b"))
    return places.select("place", first.alias("exist_from"), last.alias("exist_to"))


@query(f"WITH {EVENTS_SQL}, {_BOUNDS} SELECT * FROM x")
def existence_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir)


@query(f"WITH {EVENTS_SQL}, {_BOUNDS} SELECT place, coalesce(-4 < exist_from, false) OR coalesce(-9 > exist_to, false) AS gated FROM x")
def existence_gate(spark, sf_dir):
    return _bounds(spark, sf_dir).select("place", timeline.gated(F.col("exist_from"), F.col("exist_to"), F.lit(-9), F.lit(-4)).alias("gated"))


@query(f"""WITH nm AS (SELECT n_nationkey AS place, n_name || ' the ' || k AS name, CAST(k * 2 - 6 AS INT) AS from_year, CAST(k * 2 - 5 AS INT) AS to_year FROM nation, (SELECT unnest([1, 2]) AS k) WHERE n_nationkey % 2 = 0),
pick AS (SELECT place, arg_max(name, (CAST(from_year <= -1 AND to_year >= -1 AS INT), from_year)) AS period FROM nm WHERE from_year <= {LAST} AND {FIRST} <= to_year GROUP BY 1)
SELECT n_nationkey AS place, coalesce(period, CASE WHEN n_nationkey % 3 = 0 THEN 'alias ' || n_name END, regexp_replace(n_name || ' 2', ' [0-9]+$', '')) AS display_name FROM nation LEFT JOIN pick ON place = n_nationkey""")
def display_name(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    places = nation.select(F.col("n_nationkey").alias("place"), F.concat("n_name", F.lit(" 2")).alias("name"))
    k = F.col("k")
    names = nation.where("n_nationkey % 2 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("n_nationkey").alias("place"), F.concat("n_name", F.lit(" the "), k.cast("string")).alias("name"), (k * 2 - 6).alias("from_year"), (k * 2 - 5).alias("to_year")
    )
    aliases = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("place"), F.concat(F.lit("alias "), "n_name").alias("alias"))
    return scene.display_names(places, names, aliases, FIRST, LAST)


@query(f"WITH {EVENTS_SQL} SELECT place, n_name AS label, count(*) AS n_events, CAST(least(count(*), 5) AS INT) AS brightness FROM ev JOIN nation ON n_nationkey = place WHERE {_IN} GROUP BY 1, 2")
def scene_lit(spark, sf_dir):
    lit = scene.lit(star.events(spark, sf_dir), FIRST, LAST)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("label"))
    return lit.join(names, "place").select("place", "label", "n_events", "brightness")


_OLD = "from_year <= -5 AND -9 <= to_year"


@query(f"WITH {EVENTS_SQL}, e2 AS (SELECT narrative AS place, from_year, to_year FROM ev) SELECT place, count(*) AS total_events FROM e2 GROUP BY 1 HAVING count(*) FILTER ({_OLD}) = 0")
def scene_quiet(spark, sf_dir):
    """Customers as places, so that some are quiet."""
    return scene.quiet(star.events(spark, sf_dir).withColumn("place", F.col("narrative")), -9, -5)


# places of arrows: an order's place is a function of its key, so that legs move
_MOVED = "mv AS (SELECT event, narrative, CAST(event % 3 AS BIGINT) AS place, from_year, to_year, order_date FROM ev)"
_ARROWS = f"""{_MOVED}, st AS (SELECT narrative, row_number() OVER w AS ord, place AS from_place, lead(place) OVER w AS to_place, event AS from_event, lead(event) OVER w AS to_event
  FROM mv WHERE {_IN} WINDOW w AS (PARTITION BY narrative ORDER BY order_date, event)), ar AS (SELECT * FROM st WHERE to_event IS NOT NULL AND from_place <> to_place)"""


def _moved(spark, sf_dir):
    return star.events(spark, sf_dir).withColumn("place", F.col("event") % 3)


@query(f"WITH {EVENTS_SQL}, {_ARROWS} SELECT narrative, CAST(ord AS BIGINT) AS step, from_place, to_place, from_event, to_event FROM ar")
def scene_arrows(spark, sf_dir):
    found = scene.arrows(_moved(spark, sf_dir), FIRST, LAST, ["order_date", "event"])
    return found.select("narrative", F.col("order").cast("long").alias("step"), "from_place", "to_place", "from_event", "to_event")


@query(f"WITH {EVENTS_SQL}, {_ARROWS} SELECT narrative, count(*) AS legs_in_scene FROM mv WHERE {_IN} AND narrative IN (SELECT narrative FROM ar) GROUP BY 1")
def scene_legend(spark, sf_dir):
    moved = _moved(spark, sf_dir)
    return scene.legend(moved, scene.arrows(moved, FIRST, LAST, ["order_date", "event"]), FIRST, LAST)


@query("""WITH v AS (SELECT o_custkey % 50 AS grp, o_orderkey AS verse, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY CAST(o_orderstatus = 'F' AS INT) DESC, o_orderkey) AS r FROM orders)
SELECT grp, count(*) AS count, string_agg(CAST(verse AS VARCHAR), ',' ORDER BY verse) FILTER (r <= 20) AS verses FROM v GROUP BY 1""")
def verse_groups_cap20(spark, sf_dir):
    verses = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderkey").alias("verse"), "o_orderstatus")
    return scene.verse_groups(verses, F.col("o_orderstatus") == "F", ["grp"])


@query(f"WITH {EVENTS_SQL} SELECT place, count(*) AS n_events FROM ev GROUP BY 1")
def events_per_place(spark, sf_dir):
    return star.events(spark, sf_dir).groupBy("place").agg(F.count(F.lit(1)).alias("n_events"))


@query(f"WITH {EVENTS_SQL} SELECT event, row_number() OVER (ORDER BY from_year, order_date, event) - 1 AS seq FROM ev")
def timeline_order(spark, sf_dir):
    # days are finer than years and order events in the same way
    events = star.events(spark, sf_dir).withColumn("day", F.unix_date(F.to_date("order_date")))
    return sequence.timeline_order(events, "day", ["order_date", "event"]).select("event", "seq")


@query(f"WITH {EVENTS_SQL} SELECT narrative, event AS prior, nxt AS next FROM (SELECT narrative, event, lead(event) OVER (PARTITION BY narrative ORDER BY from_year, order_date, event) AS nxt FROM ev) WHERE nxt IS NOT NULL")
def temporal_adjacency(spark, sf_dir):
    return sequence.steps(star.events(spark, sf_dir), ["narrative"], "event", ["from_year", "order_date", "event"])


@query("SELECT user_id, event_id, lag(event_id) OVER w AS earlier, lead(event_id) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def timeline_neighbours(spark, sf_dir):
    return sequence.neighbours(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["ts", "event_id"])


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT event, from_year, lag(from_year) OVER (PARTITION BY narrative ORDER BY order_date, event) AS leg FROM ev)
SELECT event, CASE WHEN event % 7 = 0 THEN 'anchor' WHEN leg IS NOT NULL THEN 'narrative' ELSE 'era' END AS basis,
CAST(CASE WHEN event % 7 = 0 THEN from_year ELSE leg END AS INT) AS year FROM k""")
def placement(spark, sf_dir):
    events = star.events(spark, sf_dir).withColumn("seq", F.struct("order_date", "event"))
    anchors = events.where("event % 7 = 0").select("event", F.col("from_year").alias("anchor_year"))
    return sequence.placements(events, anchors)


@query("SELECT n_nationkey AS polity, min(y) AS reign_from, max(y) AS reign_to FROM (SELECT c_nationkey AS n_nationkey, CAST(year(o_orderdate) AS INT) AS y FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1")
def reign_span(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    y = F.year("o_orderdate")
    return orders.groupBy(F.col("c_nationkey").alias("polity")).agg(F.min(y).alias("reign_from"), F.max(y).alias("reign_to"))


@query(f"""WITH era AS (SELECT n_nationkey AS polity, k AS era, CAST(k * 3 - 9 AS INT) AS a, CAST(k * 3 - 6 - n_nationkey % 2 AS INT) AS b FROM nation, (SELECT unnest([1, 2, 4, 5]) AS k)),
z AS (SELECT polity, era, CASE WHEN a <= 0 THEN a - 1 ELSE a END AS from_year, CASE WHEN b <= 0 THEN b - 1 ELSE b END AS to_year FROM era)
SELECT polity, CAST(era AS INT) AS era, CAST(from_year AS INT) AS from_year, CAST(to_year AS INT) AS to_year FROM z WHERE {_IN}""")
def polities_in_window(spark, sf_dir):
    k, flip = F.col("era"), lambda y: F.when(y <= 0, y - 1).otherwise(y)
    eras = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polity"), F.explode(F.array(*map(F.lit, (1, 2, 4, 5)))).alias("era"))
    eras = eras.withColumns({"from_year": flip(k * 3 - 9), "to_year": flip(k * 3 - 6 - F.col("polity") % 2)})
    return scene.in_window(eras, FIRST, LAST)


@query(f"""WITH {EVENTS_SQL} SELECT event, CASE WHEN from_year = CAST(event % 5 - 3 AS INT) AND event % 4 = 0 THEN 'stale' WHEN from_year = CAST(event % 5 - 3 AS INT) THEN 'ok'
WHEN event % 4 = 0 THEN 'deferred' ELSE 'mismatch' END AS status FROM ev WHERE event % 2 = 0""")
def anchor_equality(spark, sf_dir):
    events = star.events(spark, sf_dir)
    anchors = events.where("event % 2 = 0").select("event", (F.col("event") % 5 - 3).cast("int").alias("anchor_year"))
    return rules.anchor_status(anchors, events, events.where("event % 4 = 0"))


@query("""WITH e AS (SELECT o_custkey AS era, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1),
r AS (SELECT era, CAST(era * 10 - 200 + CASE WHEN era * 10 - 200 >= 0 THEN 1 ELSE 0 END AS INT) AS f, CAST(era * 10 - 191 + n % 3 - 1 + CASE WHEN era * 10 - 191 + n % 3 - 1 >= 0 THEN 1 ELSE 0 END AS INT) AS t FROM e),
w AS (SELECT *, lag(t) OVER (ORDER BY f, era) AS p, lead(f) OVER (ORDER BY f, era) AS nx FROM r),
d AS (SELECT *, CASE WHEN p = -1 THEN 1 ELSE p + 1 END AS due FROM w)
SELECT era, problem FROM (SELECT era, CASE WHEN f = 0 OR t = 0 OR f > t THEN 'range' WHEN p IS NULL AND f <> -4004 THEN 'start' WHEN f > due THEN 'gap' WHEN f < due THEN 'overlap'
WHEN nx IS NULL AND t <> 100 THEN 'end' END AS problem FROM d) WHERE problem IS NOT NULL""")
def era_gaps(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("era")).agg(F.count(F.lit(1)).alias("n"))
    year = lambda i: timeline.index_year(i).cast("int")
    eras = n.select("era", year(F.col("era") * 10 - 200).alias("from_year"), year(F.col("era") * 10 - 191 + F.col("n") % 3 - 1).alias("to_year"))
    return rules.era_gaps(eras, *timeline.UNDATED)


@query(f"""WITH {EVENTS_SQL} SELECT event, CASE WHEN place % 5 = 4 THEN 'missing' ELSE 'outside' END AS problem FROM ev WHERE place % 5 = 4 OR from_year < -3 OR to_year > 2""")
def window_violations(spark, sf_dir):
    windows = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("place"), F.lit(-3).alias("w_first"), F.lit(2).alias("w_last"))
    return rules.outside_window(star.events(spark, sf_dir), windows, "place").select("event", "problem")


@query(f"""WITH {EVENTS_SQL} SELECT 'duplicate-line' AS law, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS subject, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'unknown-part', CAST(l_partkey AS VARCHAR), 'no such part' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)
UNION ALL SELECT 'leg-order', CAST(event AS VARCHAR), 'before ' || b FROM (SELECT event, from_year, lag(from_year) OVER (PARTITION BY narrative ORDER BY event) AS b FROM ev) WHERE from_year < b""")
def violations_union(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    twice = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unknown = rules.unknown(lines.select("l_partkey"), "l_partkey", table(spark, sf_dir, "part").where("p_size > 1"), "p_partkey")
    back = rules.backwards(star.events(spark, sf_dir), "narrative", ["event"], "from_year")
    return rules.all_of(
        rules.violations(twice, "duplicate-line", F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("n")),
        rules.violations(unknown, "unknown-part", "l_partkey", "no such part"),
        rules.violations(back, "leg-order", "event", F.concat(F.lit("before "), F.col("before").cast("string"))),
    )


@query(f"WITH {EVENTS_SQL} SELECT event, CAST(CASE WHEN from_year > 0 THEN from_year + 3 ELSE from_year END AS INT) AS from_year, CAST(CASE WHEN from_year > 0 THEN to_year + 3 ELSE to_year END AS INT) AS to_year FROM ev")
def calibration(spark, sf_dir):
    return rules.calibrated(star.events(spark, sf_dir)).select("event", "from_year", "to_year")


@query(f"WITH {EVENTS_SQL} SELECT event, from_year AS before, CAST(CASE WHEN event % 11 = 0 THEN -7 ELSE from_year END AS INT) AS from_year, CAST(CASE WHEN event % 11 = 0 THEN -6 ELSE to_year END AS INT) AS to_year, event % 11 = 0 AS changed FROM ev")
def date_overrides(spark, sf_dir):
    events = star.events(spark, sf_dir)
    overrides = events.where("event % 11 = 0").select("event", F.lit(-7).alias("new_from"), F.lit(-6).alias("new_to"))
    return rules.overridden(events, overrides)


def _points(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("place"), (k * 1.5 + 8).alias("lat"), (k * 2.5 - 8).alias("lon"))


@query("""WITH p AS (SELECT n_nationkey AS place, n_nationkey * 1.5 + 8 AS lat, n_nationkey * 2.5 - 8 AS lon FROM nation)
SELECT a.place AS a, b.place AS b, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 3) AS km
FROM p a JOIN p b ON b.place = a.place + 1""")
def haversine(spark, sf_dir):
    p = _points(spark, sf_dir)
    a, b = p.alias("a"), p.alias("b")
    km = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("b.place") == F.col("a.place") + 1).select(F.col("a.place").alias("a"), F.col("b.place").alias("b"), F.round(km, 3).alias("km"))


@query("""SELECT n_nationkey AS place, n_nationkey * 1.5 + 8 BETWEEN 7.6 AND 48.9 AND n_nationkey * 2.5 - 8 BETWEEN -10.9 AND 71.4 AS inside FROM nation""")
def bbox(spark, sf_dir):
    return _points(spark, sf_dir).select("place", geo.in_box(F.col("lat"), F.col("lon")).alias("inside"))


@query("""SELECT n_nationkey AS place, (n_nationkey * 1.5 + 8 < 30 AND n_nationkey * 2.5 - 8 < 20 AND n_nationkey * 1.5 + 8 >= 9 AND n_nationkey * 2.5 - 8 >= 0) AS inside FROM nation""")
def point_in_ring(spark, sf_dir):
    corner = lambda lat, lon: F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    ring = F.array(corner(9, 0), corner(30, 0), corner(30, 20), corner(9, 20))
    return _points(spark, sf_dir).select("place", geo.in_ring(F.col("lat"), F.col("lon"), ring).alias("inside"))
