"""Queries over reading order and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import refs, text
from tessera.operators import reading, rules, sequence
from tessera.plans.registry import query
from tessera.sources import sections, star
from tessera.sources.star import table

_SPINE = "sp AS (SELECT conv_id AS chapter, turn AS verse, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord FROM conversations)"


def _spine(spark, sf_dir):
    return reading.spine(star.spine(spark, sf_dir))


@query(f"WITH {_SPINE} SELECT ord, chapter, verse, text FROM sp WHERE ord BETWEEN 30 AND 49")
def reading_window_fwd(spark, sf_dir):
    return reading.window(_spine(spark, sf_dir), 30, 20).select("ord", "chapter", "verse", "text")


@query(f"WITH {_SPINE} SELECT ord, chapter, verse, text FROM sp WHERE ord BETWEEN 0 AND 19")
def reading_window_bwd(spark, sf_dir):
    """Back from place 4: the window can't begin before 0 and so runs past it."""
    return reading.window(_spine(spark, sf_dir), 4, 20, backward=True).select("ord", "chapter", "verse", "text")


@query(f"WITH {_SPINE} SELECT chapter, min(ord) AS first_ord, CAST(least(count(*), 200) AS BIGINT) AS n_units FROM sp GROUP BY 1")
def chapter_span(spark, sf_dir):
    return reading.chapter_spans(_spine(spark, sf_dir)).select("chapter", "first_ord", F.col("n_units").cast("long").alias("n_units"))


@query(f"WITH {_SPINE} SELECT CAST(chapter % 10 AS BIGINT) AS grp, count(DISTINCT chapter) AS n_chapters, count(*) AS n_units, min(ord) AS first_ord FROM sp GROUP BY 1")
def contents_tree(spark, sf_dir):
    return reading.contents(_spine(spark, sf_dir), F.col("chapter") % 10)


_LINES = "v AS (SELECT DISTINCT l_suppkey AS owner, l_orderkey // 4 AS chapter, l_orderkey % 4 + 1 AS verse FROM lineitem)"
_RUNS = f"""{_LINES}, g AS (SELECT *, lag(chapter) OVER w AS c, lag(verse) OVER w AS p FROM v WINDOW w AS (PARTITION BY owner ORDER BY chapter, verse)),
m AS (SELECT *, CASE WHEN coalesce((c = chapter AND p + 1 = verse) OR (c + 1 = chapter AND verse = 1 AND p = 4), false) THEN 0 ELSE 1 END AS nw FROM g),
r AS (SELECT *, sum(nw) OVER (PARTITION BY owner ORDER BY chapter, verse) AS run FROM m)"""


@query(f"""WITH {_RUNS} SELECT owner, min((chapter, verse))[1] AS from_chapter, min((chapter, verse))[2] AS from_verse, max((chapter, verse))[1] AS to_chapter, max((chapter, verse))[2] AS to_verse, count(*) AS n_verses
FROM r GROUP BY owner, run""")
def runs_coalesce(spark, sf_dir):
    k = F.col("l_orderkey")
    verses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.expr("l_orderkey div 4").alias("chapter"), (k % 4 + 1).alias("verse"))
    ends = verses.select("chapter", F.lit(4).cast("long").alias("last_verse")).distinct()
    return reading.runs(verses, ["owner"], ends=ends)


@query("""SELECT unit, layer, kind, year, heading FROM (SELECT l_partkey AS unit, l_tax AS t, CAST(l_linenumber % 3 AS INT) AS layer, l_returnflag AS kind, CAST(year(l_shipdate) AS INT) AS year, l_orderkey AS heading,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_linestatus = 'F', l_linenumber % 3 DESC, l_returnflag DESC, year(l_shipdate), l_quantity, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def heading_winner(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("unit"),
        (F.col("l_linestatus") == "F").alias("is_continuation"),
        (F.col("l_linenumber") % 3).alias("layer"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_returnflag").alias("kind_rank"),
        F.year("l_shipdate").alias("year"),
        F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
        F.col("l_orderkey").alias("heading"),
    )
    return reading.heading_winners(lines, ["unit"]).select("unit", "layer", "kind", "year", "heading")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS id FROM (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS s,
row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""")
def slug_suffix(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_brand")).alias("slug"))
    return sequence.suffixed(part, "slug", ["p_partkey"]).select("p_partkey", "id")


_CODES = ", ".join(f"('{c}', {i})" for c, i in refs.BOOK_INDEX.items())
_REFS = """r AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'gen' WHEN 1 THEN 'JHN.' || o_custkey WHEN 2 THEN 'PSA.' || o_custkey || '.' || o_orderkey
  WHEN 3 THEN 'XXX.1.2' WHEN 4 THEN 'Rev.3.' || o_custkey || '-' || o_orderkey ELSE 'ACT.0.1' END AS ref FROM orders)"""


@query(f"""WITH b(code, book) AS (VALUES {_CODES}), {_REFS}, q AS (SELECT k, upper(split_part(ref, '.', 1)) AS code, try_cast(nullif(split_part(ref, '.', 2), '') AS INT) AS c,
 try_cast(nullif(split_part(split_part(ref, '.', 3), '-', 1), '') AS INT) AS v, try_cast(nullif(split_part(split_part(ref, '.', 3), '-', 2), '') AS INT) AS w FROM r),
f AS (SELECT q.*, b.book, CASE WHEN b.book IS NULL THEN NULL WHEN c IS NULL THEN 'book' WHEN c NOT BETWEEN 1 AND 65535 THEN NULL WHEN v IS NULL THEN 'chapter'
 WHEN v NOT BETWEEN 1 AND 65535 THEN NULL WHEN w IS NULL THEN 'verse' WHEN w BETWEEN 1 AND 65535 AND v < w THEN 'passage' END AS form FROM q LEFT JOIN b USING (code))
SELECT k, form, CASE WHEN form IS NOT NULL THEN book END AS book, CASE WHEN form IS NOT NULL THEN c END AS chapter, CASE WHEN form IS NOT NULL THEN v END AS first, CASE WHEN form IS NOT NULL THEN coalesce(w, v) END AS last FROM f""")
def ref_parse(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = (
        F.when(k % 6 == 0, F.lit("gen"))
        .when(k % 6 == 1, F.concat(F.lit("JHN."), c))
        .when(k % 6 == 2, F.concat(F.lit("PSA."), c, F.lit("."), k))
        .when(k % 6 == 3, F.lit("XXX.1.2"))
        .when(k % 6 == 4, F.concat(F.lit("Rev.3."), c, F.lit("-"), k))
        .otherwise(F.lit("ACT.0.1"))
    )
    return refs.parse_ref(table(spark, sf_dir, "orders").select(k.alias("k"), ref.alias("ref")), "ref").drop("ref")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[’''–-][\\p{L}\\p{N}]+)*')) AS BIGINT) AS n_tokens FROM documents")
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""SELECT doc_id, ord, token FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS ord FROM (
SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[’''–-][\\p{L}\\p{N}]+)*') AS t FROM documents))""".replace("generate_subscripts(t, 1) - 1 AS ord", "CAST(generate_subscripts(t, 1) - 1 AS INT) AS ord"))
def token_places(spark, sf_dir):
    """Every token, cut from the text by its span."""
    spans = text.token_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = spans.select("doc_id", "text", F.explode("tokens").alias("t"))
    return each.select("doc_id", "t.ord", F.substring("text", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")).alias("token"))


_CITING = "c AS (SELECT o_orderkey AS k, 'See Gen. ' || o_custkey % 50 || ':' || o_orderkey % 9 + 1 || '-' || o_custkey % 11 || ' and 1 John 2, 3ff. ' || o_orderpriority AS t FROM orders)"


@query(f"""WITH {_CITING}, x AS (SELECT o_orderkey AS k, o_custkey % 50 AS c, o_orderkey % 9 + 1 AS a, o_custkey % 11 AS b FROM orders)
SELECT k, 0 AS book, CAST(c AS INT) AS chapter, CAST(a AS INT) AS first, CAST(b AS INT) AS last FROM x WHERE a <= b UNION ALL SELECT k, 61, 2, 3, 3 FROM x""")
def citation_scan(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    prose = F.concat(F.lit("See Gen. "), c % 50, F.lit(":"), k % 9 + 1, F.lit("-"), c % 11, F.lit(" and 1 John 2, 3ff. "), "o_orderpriority")
    found = text.citation_spans(table(spark, sf_dir, "orders").select(k.alias("k"), prose.alias("text")))
    return found.select("k", F.explode("citations").alias("x")).select("k", "x.book", "x.chapter", "x.first", "x.last")


@query("""WITH t AS (SELECT c_mktsegment AS a, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN substr(lower(c_mktsegment), 3) WHEN 3 THEN 'x ' || c_mktsegment WHEN 4 THEN NULL ELSE 'other' END AS b FROM customer)
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a = b THEN 'same' WHEN lower(a) = lower(b) THEN 'case' WHEN ends_with(lower(a), lower(b)) THEN 'tail' WHEN ends_with(lower(b), lower(a)) THEN 'mirror' ELSE 'residue' END AS bucket FROM t) GROUP BY 1""")
def case_transfer_buckets(spark, sf_dir):
    a, k = F.col("c_mktsegment"), F.col("c_custkey") % 6
    other = F.when(k == 0, a).when(k == 1, F.lower(a)).when(k == 2, F.substring(F.lower(a), F.lit(3), F.length(a))).when(k == 3, F.concat(F.lit("x "), a)).when(k == 5, F.lit("other"))
    rows = table(spark, sf_dir, "customer").select(text.case_bucket(a, other).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k, calendar, year, approx FROM (SELECT o_orderkey AS k, 'BC' AS calendar, o_custkey AS year, o_orderkey % 2 = 0 AS approx FROM orders UNION ALL SELECT o_orderkey, 'AD', o_custkey % 100, false FROM orders)""")
def date_clauses(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    prose = F.concat(F.when(k % 2 == 0, "In about ").otherwise("In "), c, F.lit(" B.C. it began, and A.D. "), c % 100, F.lit(" it ended."))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(text.date_clauses(prose)).alias("d"))
    return rows.select("k", "d.calendar", "d.year", "d.approx")


_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS)


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' of the ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '' AND x NOT IN ({_STOP}))), ' ') AS words FROM part""")
def title_words(spark, sf_dir):
    title = F.concat(F.col("p_name"), F.lit(" of the "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(text.title_words(title)), " ").alias("words"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query("""WITH c AS (SELECT l_orderkey AS owner, x AS start FROM lineitem, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT CASE WHEN k = 0 THEN CAST(l_linenumber AS BIGINT) ELSE CAST(l_linenumber + l_quantity AS BIGINT) END AS x) GROUP BY 1, 2),
p AS (SELECT owner, start, lead(start) OVER (PARTITION BY owner ORDER BY start) AS e FROM c)
SELECT p.owner, p.start, p.e AS "end", count(*) AS n_spans FROM p JOIN lineitem ON l_orderkey = owner AND l_linenumber <= start AND CAST(l_linenumber + l_quantity AS BIGINT) >= e WHERE e IS NOT NULL GROUP BY 1, 2, 3""")
def text_segments(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("end")
    )
    return reading.segments(spans, ["owner"])


@query("""WITH d AS (SELECT 'core' AS section, 'nation' || chr(9) || '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS line FROM nation
UNION ALL SELECT 'core', 'region' || chr(9) || '{"k":' || r_regionkey || ',"n":"' || r_name || '"}' FROM region
UNION ALL SELECT 'people', 'customer' || chr(9) || '{"k":' || c_custkey || ',"n":"' || c_name || '"}' FROM customer)
SELECT section, n_rows, sha256(n_rows || ',' || s0 || ',' || s1 || ',' || s2 || ',' || s3) AS hash FROM (
 SELECT section, count(*) AS n_rows, sum(CAST('0x' || substr(x, 1, 15) AS BIGINT)) AS s0, sum(CAST('0x' || substr(x, 16, 15) AS BIGINT)) AS s1,
  sum(CAST('0x' || substr(x, 31, 15) AS BIGINT)) AS s2, sum(CAST('0x' || substr(x, 46, 15) AS BIGINT)) AS s3 FROM (SELECT section, sha256(line) AS x FROM d) GROUP BY 1)""")
def manifest_hash(spark, sf_dir):
    parts = {
        ("core", "nation"): table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")),
        ("core", "region"): table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")),
        ("people", "customer"): table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")),
    }
    return sections.section_hashes(parts)


@query("SELECT 'none' AS side, CAST(0 AS BIGINT) AS n_rows WHERE false")
def roundtrip_except(spark, sf_dir):
    """A table written as sections and read back differs in no row."""
    nodes = star.nodes(spark, sf_dir).withColumn("section", F.when(F.col("kind") == "TextUnit", "text").otherwise("core"))
    back = sections.reload(spark, sections.write(nodes, sections.scratch(spark, "roundtrip")))
    return rules.same_tables(nodes, back.select(nodes.columns)).groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"))
