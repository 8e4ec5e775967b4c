"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tessera.llm import line_dedup, quality

_WORD = r"[^\x20\x09-\x0D]+"
_quote = lambda s: s.replace("'", "''")

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d),
tri AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS covered FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
ln AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT k, line, len(regexp_extract_all(line, '{_WORD}')) AS n, length(array_to_string(regexp_extract_all(line, '{_WORD}'), '')) AS chars,
  len(regexp_extract_all(line, '{_quote(quality.SYMBOLS)}')) AS s, len(regexp_extract_all(line, '{_quote(quality.SHOUTS)}')) AS sh,
  len(regexp_extract_all(line, '{_quote(quality.SEPARATORS)}')) AS b FROM ln),
lf AS (SELECT k, line, n, chars, n > 0 AND ((s >= 3 AND s * 10 > n * 3) OR (sh >= 3 AND sh * 5 > n) OR b >= 3 OR (b >= 1 AND n <= 5)
  OR (n <= 20 AND regexp_matches(line, '{_quote(quality._BOILERPLATE)}')) OR (n <= 2 AND NOT regexp_matches(line, '{_quote(quality.CLOSING)}'))) AS fails FROM lw),
ld AS (SELECT k, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM lf GROUP BY k),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '{_quote(quality.SYMBOLS)}')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, lost FROM w JOIN ld USING (k) LEFT JOIN cov USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) AND lost <= {quality.MAX_LOST} * word_chars AS kept FROM x"""

# Letters of the corpus's languages beside ASCII, and control characters that stand for them: levenshtein counts bytes.
_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍáúâîàùô"
_CONTROLS = " || ".join(f"chr({c})" for c in range(1, 32) if c not in (9, 10, 13))
_ERRORS = f"least({line_dedup.MOST}, greatest(1, {{}} // {line_dedup.RATE}))"

# A line within e edits of a shorter one has one of the shorter one's e + 1 parts somewhere.
LINE_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
every AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS place FROM d),
occ AS (SELECT * FROM every WHERE line <> ''),
ln AS (SELECT line, length(line) AS n, min((doc_id, place)) AS line_first, row_number() OVER (ORDER BY line) AS id FROM occ GROUP BY line),
sh AS (SELECT id, line, n, translate(line, '{_LETTERS}', {_CONTROLS}) AS code, {_ERRORS.format("n")} AS e FROM ln WHERE n >= {line_dedup.MIN_CHARS}),
near AS (SELECT a.id AS a, b.id AS b, a.code AS x, b.code AS y, a.e AS e FROM sh a JOIN sh b ON b.n BETWEEN a.n AND a.n + {line_dedup.MOST}
  WHERE a.id <> b.id AND b.n - a.n <= a.e AND len(list_filter(range(0, a.e + 1), lambda k: contains(b.line, substr(a.line, 1 + k * a.n // (a.e + 1), (k + 1) * a.n // (a.e + 1) - k * a.n // (a.e + 1))))) > 0),
links AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM near WHERE levenshtein(x, y) <= e),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM ends UNION SELECT r.id, e.b FROM reach r JOIN ends e ON e.a = r.other),
cls AS (SELECT ln.id, ln.line, ln.line_first, coalesce(c, ln.id) AS class_id FROM ln LEFT JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) r ON r.id = ln.id),
sized AS (SELECT c.class_id, min(c.line_first) AS first, count(DISTINCT c.id) AS n_lines FROM cls c GROUP BY c.class_id),
times AS (SELECT c.class_id, count(*) AS n FROM occ o JOIN cls c USING (line) GROUP BY c.class_id),
marked AS (SELECT o.doc_id, o.place, s.first, s.n_lines, c.line_first, (o.doc_id, o.place) <> s.first AS gone
  FROM occ o JOIN cls c USING (line) JOIN sized s USING (class_id) JOIN times t USING (class_id) WHERE t.n > 1),
byd AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND line_first <> first) AS n_removed_near, CAST(sum(n_lines - 1) AS BIGINT) AS n_links,
  min(first[1]) FILTER (gone) AS first_doc, array_to_string(list_sort(list(DISTINCT first[1] || ':' || first[2])), ',') AS classes FROM marked GROUP BY doc_id),
kept AS (SELECT e.doc_id, sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.place) FILTER (NOT coalesce(m.gone, false)), '')) AS cleaned_sha256, count(*) AS n_lines
  FROM every e LEFT JOIN marked m ON m.doc_id = e.doc_id AND m.place = e.place GROUP BY e.doc_id)
SELECT k.doc_id, k.n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed_near, 0) AS n_removed_near, coalesce(n_links, 0) AS n_links,
  first_doc, coalesce(classes, '') AS classes, cleaned_sha256 FROM kept k LEFT JOIN byd b USING (doc_id)"""


def oracles() -> dict[str, str]:
    return {"op2_quality": QUALITY, "op9_line_dedup": LINE_DEDUP}
