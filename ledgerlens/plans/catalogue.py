"""Queries over the parquet tables, one for each operator of the library, with their SQL.

The tables are a generic star schema, so each query first takes a deterministic projection of
them (the SQL texts below, which both engines read) and then applies an operator.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scale as S
from ..functions import text as T
from ..operators import evaluate, extract, merge, pageoffset, report, spans, toc
from ..operators import verify as V
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- projections, readable by Spark and DuckDB; {table} is a table ------------------------------
DOCS = "SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year, c_name AS company FROM {orders} JOIN {customer} ON o_custkey = c_custkey"
FIELD = "CASE l_linenumber WHEN 1 THEN 'scr_total' WHEN 2 THEN 'mcr_total' WHEN 3 THEN 'eof_total' WHEN 4 THEN 'tech_provisions_total' WHEN 5 THEN 'sii_ratio_pct' WHEN 6 THEN 'eof_t1' ELSE 'eof_t2' END"
EXTRACTIONS = f"SELECT l_orderkey AS doc_id, {FIELD} AS field_id, l_extendedprice AS value, CASE WHEN l_linenumber = 5 THEN '%' ELSE 'EUR' END AS unit, l_returnflag <> 'R' AS verified, l_shipdate AS s1, l_partkey AS s2, l_suppkey AS s3 FROM {{lineitem}}"
OVERRIDES = "SELECT o_orderkey AS doc_id, 'scr_total' AS field_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS value, 'EUR' AS unit, 'review' AS note FROM {orders} WHERE o_orderkey % 37 = 0 UNION ALL SELECT o_orderkey, 'sii_ratio_pct', CAST(150 AS DOUBLE), '%', 'review' FROM {orders} WHERE o_orderkey % 53 = 0"
KNOWN = "SELECT o_orderkey AS doc_id FROM {orders} WHERE o_orderkey % 11 <> 0"
GOLD = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'scr_total' WHEN 1 THEN 'mcr_total' WHEN 2 THEN 'eof_total' ELSE 'sii_ratio_pct' END AS field_id, CASE WHEN o_orderkey % 4 = 3 THEN '%' ELSE 'EUR' END AS unit, o_totalprice AS value FROM {orders}"
#: Gold near the extracted values, so that every outcome occurs.
GOLD_NEAR = f"SELECT l_orderkey AS doc_id, {FIELD} AS field_id, CASE WHEN l_linenumber = 5 OR min(l_suppkey) % 7 = 0 THEN '%' ELSE 'EUR' END AS unit, min(l_extendedprice) + CASE WHEN min(l_suppkey) % 2 = 0 THEN 100 ELSE 0 END AS value FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber UNION ALL SELECT o_orderkey, 'unknown', 'EUR', o_totalprice FROM {{orders}}"
HITS = "SELECT CAST(p_partkey % 100 AS INT) AS doc_id, p_partkey AS hit_seq, substr('ABCDE', CAST(floor(p_partkey / 100) AS INT) % 5 + 1, 1) AS letter, p_size AS page FROM {part}"
ITEMS = "SELECT CAST(p_partkey % 100 AS INT) AS doc_id, p_partkey AS seq, p_size AS page, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(substr('ABCDE', CAST(floor(p_partkey / 100) AS INT) % 5 + 1, 1), '.', CAST(p_partkey % 12 + 1 AS STRING)) END AS left_marker FROM {part}"
PAGE_COUNTS = "SELECT DISTINCT CAST(p_partkey % 100 AS INT) AS doc_id, 60 AS page_count FROM {part}"
LISTED_SECTIONS = "SELECT CAST(p_partkey % 50 AS INT) AS doc_id, p_partkey AS seq, CASE WHEN p_partkey % 91 = 0 THEN 'Z' ELSE substr('ABCDE', CAST(floor(p_partkey / 50) AS INT) % 5 + 1, 1) END AS section, p_size AS start_page, CAST(p_size + p_partkey % 4 - 1 AS INT) AS end_page FROM {part}"
PAGE_HITS = "SELECT user_id AS doc_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS page_index, CASE WHEN event_type = 'signup' THEN 'roman' ELSE 'arabic' END AS kind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - user_id % 5 + CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS INT) AS printed FROM {events}"
PAGES = "SELECT CAST(doc_id % 20 AS INT) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS INT) AS page, text FROM {documents}"
NUMBER_TEXT = "concat('SCR E.', CAST(l_linenumber AS STRING), '.2 ', CAST(l_partkey % 900 + 100 AS STRING), '.', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), ',5 (', CAST(l_partkey % 90 + 10 AS STRING), ' 123) ', CASE l_returnflag WHEN 'R' THEN 'TEUR' WHEN 'A' THEN 'Mio EUR' ELSE 'EUR' END, CASE WHEN l_linenumber = 5 THEN ' 12%' ELSE '' END)"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
TABLES = re.compile(r"\{(\w+)\}")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(TABLES.findall(sql))})


def duck(sql: str) -> str:
    """The projection as DuckDB reads it."""
    return TABLES.sub(r"\1", sql).replace(" AS STRING)", " AS VARCHAR)")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- merges -------------------------------------------------------------------------------------
ORDER = ("s1", "s2", "s3")


def order():
    return [F.col(c) for c in ORDER]


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedupe(rows(spark, sf_dir, EXTRACTIONS), ["doc_id", "field_id"], order())


_LATEST = f"SELECT doc_id, field_id, value, unit, verified, s1, s2, s3 FROM ({duck(EXTRACTIONS)}) QUALIFY row_number() OVER (PARTITION BY doc_id, field_id ORDER BY s1 DESC, s2 DESC, s3 DESC) = 1"
_FINAL = f"""
WITH x AS ({_LATEST}), o AS ({duck(OVERRIDES)}), known AS ({duck(KNOWN)}),
pool AS (
  SELECT doc_id, field_id, value, unit, 'extracted' AS source_type, NULL AS source_note, 2 AS p FROM x
  WHERE verified AND NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = x.doc_id AND o.field_id = x.field_id)
  UNION ALL SELECT doc_id, field_id, value, unit, 'manual', note, 0 FROM o),
ratio AS (
  SELECT doc_id, format('{{:.2f}}', 100 * max(value) FILTER (field_id = 'eof_total') / nullif(max(value) FILTER (field_id = 'scr_total'), 0))::DOUBLE AS value FROM pool GROUP BY doc_id),
every AS (
  SELECT * FROM pool UNION ALL SELECT doc_id, 'sii_ratio_pct', value, '%', 'derived', 'Eigenmittel / SCR', 1 FROM ratio WHERE value IS NOT NULL)
SELECT doc_id, field_id, value, unit, source_type, source_note, true AS verified FROM every
WHERE doc_id IN (SELECT doc_id FROM known) QUALIFY row_number() OVER (PARTITION BY doc_id, field_id ORDER BY p) = 1"""


@query("final_values", _FINAL)
def final_values(spark, sf_dir):
    return merge.final_values(latest(spark, sf_dir), rows(spark, sf_dir, OVERRIDES), rows(spark, sf_dir, KNOWN))


@query("docs_display_name", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Report' WHEN company <> '' THEN company || ' (' || year || ')' ELSE doc_id::VARCHAR END AS display_name FROM ({duck(DOCS)})")
def docs_display_name(spark, sf_dir):
    d = rows(spark, sf_dir, DOCS).withColumn("given", F.when(F.col("doc_id") % 5 == 0, " Report ").otherwise(""))
    return d.select("doc_id", report.display_name(F.col("given"), F.col("company"), F.col("year"), F.col("doc_id")).alias("display_name"))


_OLD = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS a, o_totalprice AS b FROM {orders} WHERE o_orderkey % 2 = 0"
_NEW = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice + 1 END AS b FROM {orders} WHERE o_orderkey % 4 < 2"


@query("upsert_coalesce", f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM ({duck(_OLD)}) o FULL JOIN ({duck(_NEW)}) n ON o.doc_id = n.doc_id")
def upsert_coalesce(spark, sf_dir):
    return merge.upsert_coalesce(rows(spark, sf_dir, _OLD), rows(spark, sf_dir, _NEW), ["doc_id"])


@query("upsert_overwrite", f"SELECT * FROM ({duck(_NEW)}) UNION ALL SELECT * FROM ({duck(_OLD)}) o WHERE doc_id NOT IN (SELECT doc_id FROM ({duck(_NEW)}))")
def upsert_overwrite(spark, sf_dir):
    return merge.upsert_overwrite(rows(spark, sf_dir, _OLD), rows(spark, sf_dir, _NEW), ["doc_id"])


_CHILD = "SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp FROM {lineitem}"


@query("orphans_removed", f"SELECT * FROM ({duck(_CHILD)}) WHERE doc_id IN (SELECT doc_id FROM ({duck(KNOWN)}))")
def orphans_removed(spark, sf_dir):
    return merge.without_orphans(rows(spark, sf_dir, _CHILD), rows(spark, sf_dir, KNOWN))


@query("fk_violations", f"SELECT * FROM ({duck(_CHILD)}) WHERE doc_id NOT IN (SELECT doc_id FROM ({duck(KNOWN)}))")
def fk_violations(spark, sf_dir):
    return merge.orphans(rows(spark, sf_dir, _CHILD), rows(spark, sf_dir, KNOWN))


@query("dedupe_last", f"SELECT doc_id, field_id, value, s2, s3 FROM ({_LATEST})")
def dedupe_last(spark, sf_dir):
    return latest(spark, sf_dir).select("doc_id", "field_id", "value", "s2", "s3")


@query("dedupe_first", f"SELECT doc_id, field_id, value, s2, s3 FROM ({_LATEST.replace(' DESC', ' ASC')})")
def dedupe_first(spark, sf_dir):
    return merge.dedupe(rows(spark, sf_dir, EXTRACTIONS), ["doc_id", "field_id"], order(), last=False).select("doc_id", "field_id", "value", "s2", "s3")


@query("verified_view", f"SELECT doc_id, field_id, value FROM ({_LATEST}) WHERE verified")
def verified_view(spark, sf_dir):
    return latest(spark, sf_dir).where("verified").select("doc_id", "field_id", "value")


_COMPARE = f"""
WITH g AS ({duck(GOLD_NEAR)}), p AS ({_LATEST}),
c AS (
  SELECT g.doc_id, g.field_id, g.unit, g.value, p.value AS pv, p.unit AS pu, p.doc_id IS NULL AS missing, coalesce(p.verified, false) AS v,
    coalesce(p.unit = g.unit AND abs(p.value - g.value) <= CASE g.unit WHEN 'EUR' THEN greatest(500.0::DOUBLE, 0.001::DOUBLE * abs(g.value)) WHEN '%' THEN 0.2::DOUBLE ELSE 0 END, false) AS ok
  FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.field_id = p.field_id)"""


@query("eval_metrics", _COMPARE + """,
n AS (
  SELECT count(*) AS n_gold, count_if(v)::BIGINT AS n_verified, count_if(v AND ok)::BIGINT AS n_correct_verified, count_if(ok)::BIGINT AS n_within_tol, count_if(missing)::BIGINT AS n_missing,
    count_if(NOT v AND ok)::BIGINT AS n_unverified_but_ok, count_if(NOT v AND NOT missing AND NOT ok AND pu <> unit)::BIGINT AS n_wrong_unit FROM c)
SELECT *, n_within_tol::DOUBLE / n_gold AS accuracy, n_correct_verified::DOUBLE / n_verified AS precision, n_correct_verified::DOUBLE / n_gold AS recall,
  n_verified::DOUBLE / n_gold AS coverage, 1 - n_verified::DOUBLE / n_gold AS abstention FROM n""")
def eval_metrics(spark, sf_dir):
    return evaluate.metrics(rows(spark, sf_dir, GOLD_NEAR), latest(spark, sf_dir))


@query("eval_errors", _COMPARE + """
SELECT doc_id, field_id, CASE WHEN missing THEN 'MISSING ' || doc_id || '/' || field_id ELSE 'WRONG ' || doc_id || '/' || field_id || ' pred=' || pv || ' ' || pu || ' gold=' || value || ' ' || unit END AS message
FROM c WHERE missing OR NOT ok""")
def eval_errors(spark, sf_dir):
    return evaluate.errors(rows(spark, sf_dir, GOLD_NEAR), latest(spark, sf_dir))


@query("eval_first_errors", _COMPARE + """
SELECT doc_id, field_id, CASE WHEN missing THEN 'MISSING ' ELSE 'WRONG ' END AS kind FROM c WHERE missing OR NOT ok ORDER BY doc_id, field_id LIMIT 50""")
def eval_first_errors(spark, sf_dir):
    e = evaluate.errors(rows(spark, sf_dir, GOLD_NEAR), latest(spark, sf_dir), first=50)
    return e.select("doc_id", "field_id", F.regexp_extract("message", "^[A-Z]+ ", 0).alias("kind"))


_PCT = "format('{{:.1f}}%', 100 * ({x}))"


@query("eval_report", _COMPARE + f""",
n AS (
  SELECT count(*) AS g, count_if(v)::BIGINT AS vf, count_if(v AND ok)::BIGINT AS cv, count_if(ok)::BIGINT AS wt, count_if(NOT v AND ok)::BIGINT AS uo, count_if(NOT v AND NOT missing AND NOT ok AND pu <> unit)::BIGINT AS wu FROM c)
SELECT concat_ws(chr(10), '=== Extraction Evaluation ===', 'Gold items            : ' || g, 'Verified predictions  : ' || vf,
  'Within tolerance (all): ' || wt || ' / ' || g || '  (accuracy=' || {_PCT.format(x='wt::DOUBLE / g')} || ')',
  'Correct among verified: ' || cv || ' / ' || vf || '  (precision=' || {_PCT.format(x='cv::DOUBLE / vf')} || ')',
  'Recall (verified corr): ' || {_PCT.format(x='cv::DOUBLE / g')},
  'Verified coverage     : ' || {_PCT.format(x='vf::DOUBLE / g')} || '   (abstention=' || {_PCT.format(x='1 - vf::DOUBLE / g')} || ')',
  'Unverified but OK     : ' || uo, 'Wrong-unit count      : ' || wu) AS report FROM n""")
def eval_report(spark, sf_dir):
    return evaluate.report(rows(spark, sf_dir, GOLD_NEAR), latest(spark, sf_dir))


@query("gold_merge", f"""
WITH g AS ({duck(GOLD)}), p AS ({_LATEST})
SELECT doc_id, field_id, unit, value, 0 AS is_new FROM g
UNION ALL SELECT doc_id, field_id, unit, NULL, 1 FROM p WHERE verified AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.field_id = p.field_id)""")
def gold_merge(spark, sf_dir):
    return merge.gold_merge(rows(spark, sf_dir, GOLD), latest(spark, sf_dir), True, order())


# --- sections -----------------------------------------------------------------------------------
_CAND = f"hits AS ({duck(HITS)}), cand AS (SELECT doc_id, hit_seq, letter, page, row_number() OVER (PARTITION BY doc_id, letter ORDER BY page, hit_seq) AS rank FROM hits QUALIFY rank <= 5)"


def _fuse_sql() -> str:
    out, before, unions = [_CAND, "s0 AS (SELECT DISTINCT doc_id, 1 AS last FROM cand)"], "s0", []
    for x in spans.LETTERS:
        out.append(f"b{x} AS (SELECT s.doc_id, s.last, coalesce(max(page) FILTER (page >= s.last), max(page) FILTER (page >= s.last - 1)) AS best FROM {before} s LEFT JOIN cand c ON c.doc_id = s.doc_id AND c.letter = '{x}' GROUP BY s.doc_id, s.last)")
        out.append(f"s{x} AS (SELECT doc_id, greatest(last, coalesce(best, last)) AS last FROM b{x})")
        before = f"s{x}"
        unions.append(f"SELECT doc_id, '{x}' AS letter, CASE WHEN best IS NOT NULL THEN greatest(best, last) END::INT AS start_page, CASE WHEN best IS NULL THEN 'Missing section {x}' WHEN best < last THEN 'Adjusted {x} start to maintain order' END AS issue FROM b{x}")
    out.append("fused AS (" + " UNION ALL ".join(unions) + ")")
    out.append(f"counts AS ({duck(PAGE_COUNTS)})")
    out.append("sections AS (SELECT f.doc_id, letter AS section, start_page, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY f.doc_id ORDER BY letter) - 1, page_count))::INT AS end_page FROM fused f JOIN counts c ON c.doc_id = f.doc_id WHERE start_page IS NOT NULL)")
    out.append(f"items AS ({duck(ITEMS)})")
    return "WITH " + ",\n".join(out)


_FUSED = _fuse_sql()


def fused(spark, sf_dir):
    return spans.fuse(rows(spark, sf_dir, HITS))


def sections(spark, sf_dir):
    return spans.section_spans(fused(spark, sf_dir), rows(spark, sf_dir, PAGE_COUNTS))


@query("section_candidates_top5", f"WITH {_CAND} SELECT * FROM cand")
def section_candidates(spark, sf_dir):
    return spans.candidates(rows(spark, sf_dir, HITS))


@query("section_fuse", _FUSED + " SELECT * FROM fused")
def section_fuse(spark, sf_dir):
    return fused(spark, sf_dir)


@query("section_spans", _FUSED + " SELECT * FROM sections")
def section_spans(spark, sf_dir):
    return sections(spark, sf_dir)


@query("section_coverage", _FUSED + """, c AS (
  SELECT counts.doc_id, coalesce(sum(end_page - start_page + 1), 0)::BIGINT AS covered, max(page_count) AS n FROM counts LEFT JOIN sections s ON s.doc_id = counts.doc_id GROUP BY counts.doc_id)
SELECT doc_id, covered, covered::DOUBLE / n AS coverage_ratio, CASE WHEN covered = 0 THEN 'No sections detected' WHEN covered::DOUBLE / n < 0.5 THEN 'Low coverage: ' || format('{:,.2f}', covered::DOUBLE / n) END AS issue FROM c""")
def section_coverage(spark, sf_dir):
    return spans.coverage(sections(spark, sf_dir), rows(spark, sf_dir, PAGE_COUNTS))


_SUB = """, coded AS (
  SELECT i.doc_id, seq, page, title, left_marker AS code, s.section, s.end_page FROM items i JOIN sections s ON s.doc_id = i.doc_id AND s.section = left_marker[1]
  WHERE left_marker <> '' AND page BETWEEN s.start_page AND s.end_page QUALIFY row_number() OVER (PARTITION BY i.doc_id, left_marker, page ORDER BY seq) = 1),
subs AS (
  SELECT doc_id, section, code, title, page AS start_page, least(end_page, coalesce(lead(page) OVER (PARTITION BY doc_id, section ORDER BY page, code), end_page)) AS end_page FROM coded)"""


def subsections(spark, sf_dir):
    return spans.subsection_spans(rows(spark, sf_dir, ITEMS), sections(spark, sf_dir))


@query("subsection_spans", _FUSED + _SUB + " SELECT * FROM subs WHERE start_page <= end_page")
def subsection_spans(spark, sf_dir):
    return subsections(spark, sf_dir)


@query("post_section", _FUSED + """, last AS (
  SELECT c.doc_id, max(page_count) AS n, coalesce(max(start_page), 0) AS last_start FROM counts c LEFT JOIN sections s ON s.doc_id = c.doc_id GROUP BY c.doc_id),
z AS (
  SELECT i.doc_id, page AS z, n FROM items i JOIN last l ON l.doc_id = i.doc_id WHERE page > greatest(1, last_start) AND NOT starts_with(left_marker, 'E.')
  QUALIFY row_number() OVER (PARTITION BY i.doc_id ORDER BY page, seq) = 1),
t AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY section DESC) AS rn FROM sections s)
SELECT t.doc_id, section, start_page, CASE WHEN rn = 1 AND z IS NOT NULL THEN z - 1 ELSE end_page END::INT AS end_page FROM t LEFT JOIN z ON z.doc_id = t.doc_id
UNION ALL SELECT doc_id, 'Z', z, n::INT FROM z""")
def post_section(spark, sf_dir):
    return spans.trailing_section(sections(spark, sf_dir), rows(spark, sf_dir, ITEMS), rows(spark, sf_dir, PAGE_COUNTS))


@query("contract_violations", f"""
WITH s AS (
  SELECT *, lag(end_page) OVER w AS before, lead(seq) OVER w IS NULL AS is_last, count_if(section = 'Z') OVER (PARTITION BY doc_id) AS zs FROM ({duck(LISTED_SECTIONS)}) WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
v AS (
  SELECT doc_id, 'start after end' AS v FROM s WHERE start_page > end_page
  UNION SELECT doc_id, 'outside document' FROM s WHERE start_page < 1 OR end_page > 48
  UNION SELECT doc_id, 'overlap' FROM s WHERE start_page <= before
  UNION SELECT doc_id, 'Z not last' FROM s WHERE section = 'Z' AND NOT is_last
  UNION SELECT doc_id, 'Z must end with the document' FROM s WHERE section = 'Z' AND end_page <> 48
  UNION SELECT doc_id, 'more than one Z' FROM s WHERE zs > 1)
SELECT doc_id, string_agg(v, ';' ORDER BY v) AS violations FROM v GROUP BY doc_id""")
def contract_violations(spark, sf_dir):
    s = rows(spark, sf_dir, LISTED_SECTIONS)
    return spans.contract_violations(s, s.select("doc_id").distinct().withColumn("page_count", F.lit(48)))


_FIELDS = [("scr_total", "E.2"), ("mcr_total", "E.2"), ("eof_total", "E.1"), ("tech_provisions_total", "D.2"), ("own_note", "S.1"), ("letter_only", "b")]


@query("field_span_resolution", _FUSED + _SUB + """, f(field_id, hint) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _FIELDS) + """),
sub AS (SELECT doc_id, code, min((start_page, end_page)) AS x FROM subs WHERE start_page <= end_page GROUP BY ALL),
r AS (
  SELECT c.doc_id, f.field_id, sub.x AS a, CASE WHEN s.start_page IS NOT NULL THEN (s.start_page, s.end_page) END AS b, c.doc_id % 4 AS o
  FROM counts c CROSS JOIN f LEFT JOIN sub ON sub.doc_id = c.doc_id AND sub.code = f.hint
  LEFT JOIN sections s ON s.doc_id = c.doc_id AND s.section = CASE WHEN upper(f.hint[1]) IN ('A', 'B', 'C', 'D', 'E') THEN upper(f.hint[1]) ELSE 'E' END)
SELECT doc_id, field_id, CASE WHEN a IS NOT NULL THEN a[1] ELSE b[1] END + o AS start_page, CASE WHEN a IS NOT NULL THEN a[2] ELSE b[2] END + o AS end_page,
  CASE WHEN a IS NULL AND b IS NULL THEN 'no_section' END AS note FROM r""")
def field_span_resolution(spark, sf_dir):
    fields = spark.createDataFrame(_FIELDS, "field_id string, subsection_hint string")
    docs = rows(spark, sf_dir, PAGE_COUNTS)
    offsets = docs.select("doc_id", (F.col("doc_id") % 4).alias("offset_arabic"))
    return spans.resolve_field_spans(fields, docs, sections(spark, sf_dir), subsections(spark, sf_dir), offsets)


_SPANS = "SELECT CAST(p_partkey % 20 AS INT) AS doc_id, p_partkey AS span_id, CAST(p_partkey % 40 - 2 AS INT) AS start_page, CAST(p_partkey % 40 + 1 AS INT) AS end_page FROM {part}"

#: PAGES by the keys of their texts: copy counts the rows of one id, from 0.
_PAGE_KEYS = "SELECT doc_id AS id, CAST(doc_id % 20 AS INT) AS doc_id, CAST(row_number() OVER w AS INT) AS page, row_number() OVER w - rank() OVER w AS copy FROM {documents} WINDOW w AS (PARTITION BY doc_id % 20 ORDER BY doc_id)"


@query("pages_in_span_text", f"""
WITH s AS ({duck(_SPANS)}), p AS ({duck(PAGES)})
SELECT s.doc_id, s.span_id, coalesce(string_agg(p.text, chr(10) ORDER BY p.page), '') AS text, count(p.page) AS n_pages
FROM s LEFT JOIN p ON p.doc_id = s.doc_id AND p.page BETWEEN greatest(1, s.start_page) AND s.end_page GROUP BY s.doc_id, s.span_id""")
def pages_in_span_text(spark, sf_dir):
    numbers = rows(spark, sf_dir, _PAGE_KEYS)

    def texts(wanted):
        ids = numbers.join(wanted, ["doc_id", "page"], "left_semi")
        # _SPANS asks for pages 1 to 40 of 20 documents, so these keys are few at any size
        docs = rows(spark, sf_dir, "SELECT doc_id AS id, text FROM {documents}").join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
        copies = docs.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("text")) - 1)
        return copies.join(ids, ["id", "copy"]).select("doc_id", "page", "text")

    return spans.pages_in_span(rows(spark, sf_dir, _SPANS), numbers, texts=texts)


# --- page numbers -------------------------------------------------------------------------------
_OFFSETS = f"""
WITH h AS ({duck(PAGE_HITS)}), o AS (SELECT doc_id, kind, page_index, page_index + 1 - printed AS off FROM h),
c AS (SELECT doc_id, kind, off, count(*) AS c, min(page_index) AS seen FROM o GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY c DESC, seen) AS r FROM c),
g AS (SELECT doc_id, kind, sum(c)::BIGINT AS n, max(off) FILTER (r = 1) AS off, max(c) FILTER (r = 1) AS c1, coalesce(max(c) FILTER (r = 2), 0) AS c2 FROM r GROUP BY doc_id, kind),
i AS (
  SELECT doc_id, kind, n, CASE WHEN NOT (c1 / n < 0.55 AND n >= 8) THEN off END AS off,
    greatest(0, least(1, c1 / n - CASE WHEN c2 > 0 THEN least(0.25::DOUBLE, c2 / n * 0.5::DOUBLE) ELSE 0 END)) AS conf FROM g),
d AS (
  SELECT doc_id, max(off) FILTER (kind = 'arabic') AS a, max(off) FILTER (kind = 'roman') AS r, coalesce(max(conf) FILTER (kind = 'arabic'), 0) AS ca,
    coalesce(max(conf) FILTER (kind = 'roman'), 0) AS cr, coalesce(max(n) FILTER (kind = 'arabic'), 0) AS n_arabic FROM i GROUP BY doc_id),
decided AS (
  SELECT doc_id, CASE WHEN n_arabic >= 6 THEN a END AS offset_arabic, r AS offset_roman, n_arabic,
    CASE WHEN n_arabic < 6 AND r IS NULL THEN 0 WHEN a IS NOT NULL THEN ca WHEN r IS NOT NULL THEN 0.7::DOUBLE * cr ELSE 0 END::DOUBLE AS confidence FROM d)"""


def offsets(spark, sf_dir):
    return pageoffset.decide_offsets(pageoffset.infer_offsets(rows(spark, sf_dir, PAGE_HITS)))


@query("page_offset", _OFFSETS + " SELECT * FROM decided")
def page_offset(spark, sf_dir):
    return offsets(spark, sf_dir)


_PRINTED = "SELECT user_id AS doc_id, event_id AS span_id, CAST(event_id % 30 + 1 AS INT) AS start_page, CAST(event_id % 30 + event_id % 7 AS INT) AS end_page FROM {events}"


@query("pdf_span_resolve", _OFFSETS + f""", s AS ({duck(_PRINTED)}), m AS (
  SELECT s.*, coalesce(offset_arabic, 0) AS o, CASE WHEN s.doc_id % 3 > 0 THEN 25 ELSE 1000000 END AS n FROM s LEFT JOIN decided d ON d.doc_id = s.doc_id),
f AS (SELECT *, greatest(1, least(start_page + o, n))::INT AS a, greatest(1, least(end_page + o, n))::INT AS b FROM m)
SELECT doc_id, span_id, start_page, end_page, a AS pdf_start, greatest(a, b) AS pdf_end FROM f""")
def pdf_span_resolve(spark, sf_dir):
    known = offsets(spark, sf_dir).withColumn("page_count", F.when(F.col("doc_id") % 3 > 0, 25))
    return pageoffset.resolve_pages(rows(spark, sf_dir, _PRINTED), known)


_BEST = "SELECT user_id AS doc_id, CAST(event_id % 50 AS INT) AS page_index, event_id AS line_seq, CAST(event_id % 4 AS INT) AS score, CASE WHEN event_type = 'view' THEN 'footer' ELSE 'header' END AS place, substr('xxxxxxxxxx', 1, CAST(event_id % 9 AS INT)) AS text FROM {events}"


@query("best_page_hit", f"SELECT * FROM ({duck(_BEST)}) QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY score DESC, place = 'footer' DESC, length(text), line_seq) = 1")
def best_page_hit(spark, sf_dir):
    return pageoffset.best_hits(rows(spark, sf_dir, _BEST))


_TOKENS = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('Page ', CAST(user_id AS STRING)) WHEN 1 THEN concat(CAST(user_id AS STRING), ' / 120') WHEN 2 THEN concat('- ', CAST(user_id AS STRING), ' -') WHEN 3 THEN 'xii' WHEN 4 THEN concat('Seite ', CAST(user_id AS STRING)) WHEN 5 THEN '(IV)' ELSE concat(CAST(user_id AS STRING), ' of 9') END AS line FROM {events}"


@query("page_number_token", rf"""
WITH t AS ({duck(_TOKENS)}), m AS (
  SELECT event_id, line, regexp_extract(line, '(?i)\bpage\s*(\d{{1,6}})\b', 1) AS a, regexp_extract(line, '(?i)\b(\d{{1,6}})\s*(?:/|of)\s*\d{{1,6}}\b', 1) AS b,
    regexp_extract(line, '^\s*[-–—(]*\s*(\d{{1,6}})\s*[-–—)]*\s*$', 1) AS c, regexp_extract(line, '(?i)^\s*[-–—(]*\s*([ivxlcdm]{{1,12}})\s*[-–—)]*\s*$', 1) AS d FROM t)
SELECT event_id, CASE WHEN a || b || c <> '' THEN 'arabic' WHEN d <> '' THEN 'roman' END AS kind, CASE WHEN a || b || c <> '' THEN a || b || c WHEN d <> '' THEN lower(d) END AS token,
  CASE WHEN a <> '' THEN 1.2 WHEN b <> '' THEN 1.1 WHEN c <> '' THEN 1.0 WHEN d <> '' THEN 0.95 END::DOUBLE AS strength FROM m""")
def page_number_token(spark, sf_dir):
    t = rows(spark, sf_dir, _TOKENS).withColumn("t", T.page_token(F.col("line")))
    return t.select("event_id", "t.kind", F.col("t.text").alias("token"), "t.strength")


@query("roman_to_int", """
WITH n AS (SELECT o_orderkey, (o_orderkey % 3999 + 1)::INT AS n FROM orders)
SELECT o_orderkey, n AS value, (['', 'M', 'MM', 'MMM'])[n // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1]
  || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS roman FROM n""")
def roman_to_int(spark, sf_dir):
    n = rows(spark, sf_dir, "SELECT o_orderkey, CAST(o_orderkey % 3999 + 1 AS INT) AS n FROM {orders}").withColumn("roman", T.roman_text(F.col("n")))
    return n.select("o_orderkey", T.roman_value(F.col("roman")).alias("value"), "roman")


_GRID = "SELECT user_id AS doc_id, CAST(event_id % 100 AS INT) AS page_index, 100 AS page_count, event_id FROM {events}"


@query("page_sampling", f"SELECT * FROM ({duck(_GRID)}) WHERE page_index < 12 OR page_index >= 88 OR page_index % 5 = 0")
def page_sampling(spark, sf_dir):
    return pageoffset.sample_pages(rows(spark, sf_dir, _GRID), "smart")


_LINES = "SELECT user_id AS doc_id, CAST(event_id % 40 AS INT) AS page_index, event_id AS line_seq, concat(' Page ', CAST(event_id % 40 + 3 AS STRING)) AS text, CAST(200 AS DOUBLE) AS x0, CAST(event_id % 800 AS DOUBLE) AS y0, CAST(240 AS DOUBLE) AS x1, CAST(event_id % 800 + 10 AS DOUBLE) AS y1, CAST(600 AS DOUBLE) AS page_width, CAST(800 AS DOUBLE) AS page_height FROM {events}"


@query("edge_lines", f"SELECT doc_id, page_index, line_seq, trim(text) AS text, CASE WHEN y1 <= 800 * 0.14::DOUBLE THEN 'header' ELSE 'footer' END AS place FROM ({duck(_LINES)}) WHERE y1 <= 800 * 0.14::DOUBLE OR y0 >= 800 - 800 * 0.14::DOUBLE")
def edge_lines(spark, sf_dir):
    return pageoffset.edge_lines(rows(spark, sf_dir, _LINES)).select("doc_id", "page_index", "line_seq", "text", "place")


@query("page_hits")
def page_hits(spark, sf_dir):
    return pageoffset.best_hits(pageoffset.page_hits(rows(spark, sf_dir, _LINES)))


# --- text and numbers ---------------------------------------------------------------------------
_SPACED = "SELECT doc_id, concat(' ', replace(text, ' the ', '  the­  ')) AS text FROM {documents}"


@query("normalize_text", f"SELECT doc_id, trim(regexp_replace(replace(replace(text, ' ', ' '), '­', ''), '\\s+', ' ', 'g')) AS text FROM ({duck(_SPACED)})")
def normalize_text(spark, sf_dir):
    return rows(spark, sf_dir, _SPACED).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


_BROKEN = "SELECT doc_id, replace(text, 'th', concat('t-', chr(10), ' h')) AS text FROM {documents}"


@query("normalize_hyphenation", rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}_])\s*-\s*\r?\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '([A-Za-zÄÖÜäöüß])\r?\n([a-zäöüß])', '\1\2', 'g'), '[ \t]{{2,}}', ' ', 'g') AS text FROM ({duck(_BROKEN)})""")
def normalize_hyphenation(spark, sf_dir):
    return rows(spark, sf_dir, _BROKEN).select("doc_id", T.normalize_hyphenation(F.col("text"), before_hyphen=False).alias("text"))


@query("normalize_hyphenation_full")
def normalize_hyphenation_full(spark, sf_dir):
    return rows(spark, sf_dir, _BROKEN).select("doc_id", T.normalize_hyphenation(F.col("text")).alias("text"))


_TEXTS = f"SELECT {KEYS}, {NUMBER_TEXT} AS text FROM {{lineitem}}"
_TOKEN_SQL = r"regexp_extract_all(regexp_replace(text, '(?i)\b[A-E]\.\d+(\.\d+)*\b', ' ', 'g'), '\(?\s*(?:\d{1,3}(?:\.\d{3})+|\d{1,3}(?: \d{3})+|\d+)(?:,\d+)?\s*%?\)?')"
_DOUBLE_SQL = r"replace(regexp_replace(x, '[.\s()%]', '', 'g'), ',', '.')::DOUBLE"
_NUMBERS_SQL = f"list_transform({_TOKEN_SQL}, lambda x: CASE WHEN x[1] = '(' THEN -1 ELSE 1 END * {_DOUBLE_SQL})"


@query("numbers_de", f"SELECT {KEYS}, len(n)::INT AS n_numbers, n[1] AS first, n[2] AS second FROM (SELECT *, {_NUMBERS_SQL} AS n FROM ({duck(_TEXTS)}))")
def numbers_de(spark, sf_dir):
    t = rows(spark, sf_dir, _TEXTS).withColumn("n", N.numbers_de(F.col("text")))
    return t.select(*KEYS.split(", "), F.size("n").alias("n_numbers"), F.get("n", 0).alias("first"), F.get("n", 1).alias("second"))


_PAIR_SQL = r"((?:\d{1,3}(?:[ .]\d{3})+|\d+)(?:,\d+)?)\s*\(\s*((?:\d{1,3}(?:[ .]\d{3})+|\d+)(?:,\d+)?)\s*\)"
_PAIR_OF = "replace(regexp_replace(regexp_extract(text, '{p}', {k}), '[.\\s]', '', 'g'), ',', '.')::DOUBLE"


@query("current_prev_pair", f"SELECT {KEYS}, {_PAIR_OF.format(p=_PAIR_SQL, k=1)} AS current, {_PAIR_OF.format(p=_PAIR_SQL, k=2)} AS previous FROM ({duck(_TEXTS)})")
def current_prev_pair(spark, sf_dir):
    t = rows(spark, sf_dir, _TEXTS).withColumn("p", N.current_previous(F.col("text")))
    return t.select(*KEYS.split(", "), F.col("p.current").alias("current"), F.col("p.previous").alias("previous"))


_SCALE_SQL = "CASE WHEN regexp_matches(text, '(?i)\\bteur\\b') THEN 1000 WHEN regexp_matches(text, '(?i)\\bmio\\b') THEN 1000000 WHEN contains(text, '%') THEN NULL WHEN regexp_matches(text, '(?i)\\beur\\b') THEN 1 END::DOUBLE"
_UNIT_SQL = "CASE WHEN contains(text, '%') THEN '%' ELSE 'EUR' END"
_LABEL_SQL = "CASE WHEN regexp_matches(text, '(?i)\\bteur\\b') THEN 'TEUR' WHEN regexp_matches(text, '(?i)\\bmio\\b') THEN 'Mio EUR' WHEN contains(text, '%') THEN '%' ELSE 'EUR' END"


@query("scale_from_source", f"SELECT {KEYS}, {_SCALE_SQL} AS scale, {_UNIT_SQL} AS unit, {_LABEL_SQL} AS label FROM ({duck(_TEXTS)})")
def scale_from_source(spark, sf_dir):
    return rows(spark, sf_dir, _TEXTS).withColumn("h", S.from_source(F.col("text"))).select(*KEYS.split(", "), "h.*")


_CAPTION = "SELECT event_id, concat('Bilanz', chr(10), ' ', CASE event_id % 4 WHEN 0 THEN 'Angaben in TEUR' WHEN 1 THEN 'Alle Beträge in EUR' WHEN 2 THEN 'Beträge in Mio. EUR' ELSE 'in tsd. Stück' END, chr(10), 'Aktiva Mrd') AS page FROM {events}"


@query("scale_caption", f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e9 WHEN 2 THEN 1e6 ELSE 1e3 END::DOUBLE AS scale, CASE event_id % 4 WHEN 0 THEN 'TEUR' WHEN 1 THEN 'Mrd' WHEN 2 THEN 'Mio EUR' ELSE 'Tsd' END AS label FROM ({duck(_CAPTION)})""")
def scale_caption(spark, sf_dir):
    return rows(spark, sf_dir, _CAPTION).withColumn("h", S.from_caption(F.col("page"))).select("event_id", "h.scale", "h.label")


_PRECEDENCE = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '12 TEUR' WHEN 1 THEN '12' ELSE '5 %' END AS source, CASE WHEN event_id % 2 = 0 THEN concat('Angaben in Mio', chr(10), 'SCR 7') ELSE '' END AS page, CASE WHEN event_id % 5 > 0 THEN CAST(1000 AS DOUBLE) END AS typical FROM {events}"


@query("scale_precedence", f"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 1000000 ELSE typical END END::DOUBLE AS scale,
  CASE event_id % 3 WHEN 0 THEN 'TEUR' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'Mio' WHEN typical IS NOT NULL THEN 'default' END ELSE '%' END AS label FROM ({duck(_PRECEDENCE)})""")
def scale_precedence(spark, sf_dir):
    return rows(spark, sf_dir, _PRECEDENCE).withColumn("h", S.infer(F.col("source"), F.col("page"), F.col("typical"))).select("event_id", "h.scale", "h.label")


_NEARBY = "SELECT event_id, concat('SCR ', CAST(event_id AS STRING)) AS source, concat('Angaben in TEUR', chr(10), substr('" + "x" * 60 + "', 1, CAST(event_id % 60 AS INT)), ' SCR ', CAST(event_id AS STRING), substr('" + " " * 40 + "', 1, CAST(event_id % 37 AS INT)), ' Mio') AS page FROM {events}"


@query("scale_nearby", f"""
WITH t AS (SELECT event_id, 16 + event_id % 60 + 1 AS pos, 11 AS one, 16 + event_id % 60 + 1 + 4 + length(event_id::VARCHAR) + event_id % 37 + 1 AS two FROM ({duck(_NEARBY)}))
SELECT event_id, CASE WHEN pos - one <= two - pos THEN 1000 ELSE 1000000 END::DOUBLE AS scale FROM t""")
def scale_nearby(spark, sf_dir):
    return rows(spark, sf_dir, _NEARBY).select("event_id", S.near_source(F.col("source"), F.col("page")).scale.alias("scale"))


_VERIFY = f"SELECT {KEYS}, CASE WHEN l_linenumber = 7 THEN 'not_found' ELSE 'ok' END AS status, CASE l_linenumber WHEN 2 THEN CAST(l_partkey % 90 + 10 AS DOUBLE) * 1000 + 123 WHEN 3 THEN CAST(7 AS DOUBLE) ELSE CAST(l_partkey % 900 + 100 AS DOUBLE) * 1000 + l_suppkey % 1000 + CAST(0.5 AS DOUBLE) END AS value_unscaled, CASE WHEN l_linenumber = 5 THEN '%' ELSE 'EUR' END AS unit, CASE WHEN l_linestatus = 'O' THEN CAST(1000 AS DOUBLE) WHEN l_linenumber = 4 THEN CAST(1234 AS DOUBLE) END AS scale, CASE WHEN l_linenumber = 6 THEN NULL ELSE {NUMBER_TEXT} END AS source_text, l_suppkey % 2 = 0 AS has_evidence FROM {{lineitem}}"
_CLOSE = "abs(value_unscaled - {c}) <= 1e-6::DOUBLE * greatest(1, abs({c}))"


@query("verify_extractions", f"""
WITH x AS (SELECT *, source_text AS text FROM ({duck(_VERIFY)})), a AS (
  SELECT *, coalesce(source_text, '') <> '' AS src, status = 'ok' AS gate, {_PAIR_OF.format(p=_PAIR_SQL, k=1)} AS cur, {_PAIR_OF.format(p=_PAIR_SQL, k=2)} AS prev, {_NUMBERS_SQL} AS nums,
    coalesce(CASE WHEN scale IN (1, 1000, 1000000, 1000000000) THEN scale END, CASE WHEN source_text IS NULL THEN 1000 ELSE {_SCALE_SQL} END, CASE WHEN unit = 'EUR' THEN 1 END)::DOUBLE AS sc FROM x),
b AS (
  SELECT *, src AND NOT coalesce(list_bool_or(list_transform(list_concat([cur, prev], nums), lambda c: {_CLOSE.format(c="c")})), false) AS missing,
    src AND coalesce({_CLOSE.format(c="prev")}, false) AS previous, format('{{:.2f}}', CASE WHEN unit = '%' THEN value_unscaled ELSE value_unscaled * sc END)::DOUBLE AS val FROM a),
c AS (
  SELECT *, round(0.5::DOUBLE + CASE WHEN src THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has_evidence THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN missing THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN previous THEN 0.25::DOUBLE ELSE 0 END, 2) AS conf FROM b)
SELECT {KEYS}, gate AND conf >= 0.5 AND NOT missing AND NOT previous AS verified, CASE WHEN gate THEN val END AS value_canonical, CASE WHEN gate THEN conf ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN gate AND unit <> '%' THEN sc END AS scale_applied, CASE WHEN NOT gate THEN '{V.NO_VALUE}' WHEN missing THEN '{V.NOT_FOUND}' WHEN previous THEN '{V.PREVIOUS_YEAR}' END AS verifier_notes FROM c""")
def verify_extractions(spark, sf_dir):
    x = rows(spark, sf_dir, _VERIFY).withColumn("typical_scale", F.when(F.col("source_text").isNull(), 1000.0)).withColumn("page_text", F.lit(None).cast("string"))
    return V.verify(x).select(*KEYS.split(", "), "verified", "value_canonical", "confidence", "scale_applied", "verifier_notes")


_RATIO = "SELECT o_orderkey AS doc_id, 'ok' AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE '%' END AS unit, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 300 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS value_unscaled, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 300 + o_orderkey % 4 AS DOUBLE) END AS ratio_expected, o_orderkey % 2 = 0 AS has_evidence FROM {orders}"


@query("verify_ratio", f"""
WITH x AS (SELECT *, value_unscaled IS NOT NULL AS gate, unit = '%' AND ratio_expected IS NOT NULL AS asked, CASE WHEN has_evidence THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS base FROM ({duck(_RATIO)})),
y AS (SELECT *, asked AND coalesce(abs(value_unscaled - ratio_expected) <= 1, false) AS near FROM x)
SELECT doc_id, gate AS verified, CASE WHEN gate THEN CASE WHEN near THEN base + 0.15::DOUBLE ELSE base END ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN NOT gate THEN '{V.NO_VALUE}' WHEN asked AND NOT near THEN 'Erwartetes Verhältnis ist ' || ratio_expected || ' anstatt ' || value_unscaled END AS verifier_notes FROM y""")
def verify_ratio(spark, sf_dir):
    x = rows(spark, sf_dir, _RATIO).withColumns({"ratio_tol": F.lit(1.0), "scale": F.lit(None).cast("double"), "typical_scale": F.lit(None).cast("double"), "source_text": F.lit(None).cast("string"), "page_text": F.lit(None).cast("string")})
    return V.verify(x).select("doc_id", "verified", "confidence", "verifier_notes")


@query("snippet_hash", "SELECT doc_id, substr(sha1(concat_ws(' | ', CASE WHEN trim(text) <> '' THEN text END, CASE WHEN doc_id % 3 > 0 THEN lang END, doc_id::VARCHAR)), 1, 16) AS hash FROM documents")
def snippet_hash(spark, sf_dir):
    d = rows(spark, sf_dir, "SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN lang ELSE ' ' END AS lang FROM {documents}")
    return d.select("doc_id", T.snippet_hash(F.col("text"), F.col("lang"), F.col("doc_id")).alias("hash"))


@query("text_chunks", r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 1200 THEN 1 ELSE ceil((length(t) - 1200) / 1120.0)::INT + 1 END)) AS k FROM d)
SELECT doc_id, k::INT AS chunk_no, md5(substr(t, k * 1120 + 1, 1200)) AS digest FROM c""")
def text_chunks(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return extract.chunk_rows(d, ["doc_id"], "text", 1200, 80).select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@query("prompt_render", "SELECT doc_id, md5('Fasse Abschnitt ' || lang || ' in Stichpunkten zusammen:' || chr(10) || text) AS digest FROM documents")
def prompt_render(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(extract.render(extract.SUMMARISE, section=F.col("lang"), chunk=F.col("text"))).alias("digest"))


# --- report -------------------------------------------------------------------------------------
_DE = "translate(format('{{:,.2f}}', {x}), ',.', '.,')"


@query("format_value_de", f"SELECT {KEYS}, {_DE.format(x='l_extendedprice * 1000')} || CASE WHEN l_linenumber = 5 THEN ' %' ELSE ' EUR' END AS text FROM lineitem")
def format_value_de(spark, sf_dir):
    x = rows(spark, sf_dir, f"SELECT {KEYS}, l_extendedprice * 1000 AS v, CASE WHEN l_linenumber = 5 THEN '%' ELSE 'EUR' END AS u FROM {{lineitem}}")
    return x.select(*KEYS.split(", "), report.value_de(F.col("v"), F.col("u")).alias("text"))


@query("metric_compact", f"""
SELECT {KEYS}, CASE WHEN l_linenumber = 5 THEN {_DE.format(x='v')} || ' %' WHEN abs(v) >= 1e9 THEN {_DE.format(x='v / 1e9')} || ' Mrd €' WHEN abs(v) >= 1e6 THEN {_DE.format(x='v / 1e6')} || ' Mio €' ELSE {_DE.format(x='v')} || ' EUR' END AS text
FROM (SELECT {KEYS}, l_extendedprice * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 100000 END AS v FROM lineitem)""")
def metric_compact(spark, sf_dir):
    x = rows(spark, sf_dir, f"SELECT {KEYS}, l_extendedprice * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 100000 END AS v, CASE WHEN l_linenumber = 5 THEN '%' ELSE 'EUR' END AS u FROM {{lineitem}}")
    return x.select(*KEYS.split(", "), report.value_compact(F.col("v"), F.col("u")).alias("text"))


_LABEL_CASE = "CASE field_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.LABELS.items()) + " ELSE field_id END"
_POS_CASE = "CASE field_id " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(report.ORDER)) + " ELSE 8 END"


@query("ui_rows", f"""
SELECT doc_id, {_POS_CASE} AS pos, {_LABEL_CASE} AS Feld, CASE WHEN value IS NULL THEN '—' ELSE {_DE.format(x='value')} || ' ' || unit END AS Wert,
  concat_ws(' – ', CASE source_type WHEN 'derived' THEN 'Abgeleitet' WHEN 'extracted' THEN 'Automatisch extrahiert' END, source_note) AS Hinweise
FROM ({_FINAL})""")
def ui_rows(spark, sf_dir):
    return report.table_rows(final_values(spark, sf_dir))


@query("metric_cards", f"""
SELECT doc_id, field_id, {_LABEL_CASE} AS label, CASE WHEN value IS NULL THEN '—' WHEN unit = '%' THEN {_DE.format(x='value')} || ' %' WHEN abs(value) >= 1e9 THEN {_DE.format(x='value / 1e9')} || ' Mrd €' WHEN abs(value) >= 1e6 THEN {_DE.format(x='value / 1e6')} || ' Mio €' ELSE {_DE.format(x='value')} || ' EUR' END AS value_text
FROM ({_FINAL}) WHERE field_id IN ('sii_ratio_pct', 'eof_total', 'scr_total', 'mcr_total')""")
def metric_cards(spark, sf_dir):
    return report.metric_cards(final_values(spark, sf_dir))


@query("final_values_lookup", f"SELECT * FROM ({_FINAL}) WHERE doc_id = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 11 <> 0) ORDER BY field_id")
def final_values_lookup(spark, sf_dir):
    known = rows(spark, sf_dir, "SELECT max(o_orderkey) AS k FROM {orders} WHERE o_orderkey % 37 = 0 AND o_orderkey % 11 <> 0").head()
    return merge.final_values_of(final_values(spark, sf_dir), known.k)


_SUMMARIES = "SELECT user_id AS doc_id, substr('ABCDEZX', CAST(event_id % 7 + 1 AS INT), 1) AS section_id, event_type AS title, CAST(event_id AS INT) AS start_page, CAST(event_id + 1 AS INT) AS end_page, concat('S', CAST(event_id AS STRING)) AS summary FROM {events}"


@query("summaries_lookup", f"SELECT section_id, title, start_page, end_page, summary FROM ({duck(_SUMMARIES)}) WHERE doc_id = (SELECT min(user_id) FROM events) ORDER BY CASE section_id WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5 ELSE 99 END, start_page")
def summaries_lookup(spark, sf_dir):
    return report.summaries_of(rows(spark, sf_dir, _SUMMARIES), rows(spark, sf_dir, "SELECT min(user_id) AS k FROM {events}").head().k)


@query("documents_list", "SELECT o_orderkey AS doc_id, c_name AS display_name, o_orderstatus AS pdf_path, o_orderpriority AS pdf_url, (o_orderkey % 90)::INT AS page_count FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY display_name, doc_id")
def documents_list(spark, sf_dir):
    return merge.document_list(rows(spark, sf_dir, "SELECT o_orderkey AS doc_id, c_name AS display_name, o_orderstatus AS pdf_path, o_orderpriority AS pdf_url, CAST(o_orderkey % 90 AS INT) AS page_count FROM {orders} JOIN {customer} ON o_custkey = c_custkey"))


@query("load_counts", "SELECT count(DISTINCT l_linestatus) AS n_docs, count(*) AS n_rows FROM lineitem")
def load_counts(spark, sf_dir):
    return merge.load_counts(rows(spark, sf_dir, "SELECT l_linestatus AS file FROM {lineitem}"))


@query("summaries_ordered", """
SELECT doc_id, section, n, row_number() OVER (PARTITION BY doc_id ORDER BY CASE section WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5 ELSE 99 END, n)::INT AS pos
FROM (SELECT user_id AS doc_id, substr('ABCDEZX', (event_id % 7 + 1)::INT, 1) AS section, event_id AS n FROM events)""")
def summaries_ordered(spark, sf_dir):
    s = rows(spark, sf_dir, "SELECT user_id AS doc_id, substr('ABCDEZX', CAST(event_id % 7 + 1 AS INT), 1) AS section, event_id AS n FROM {events}")
    w = Window.partitionBy("doc_id").orderBy(report.section_rank(F.col("section")), "n")
    return s.withColumn("pos", F.row_number().over(w))


_LISTED = "SELECT c_custkey AS doc_id, c_name AS path FROM {customer}"


@query("resume_filter", f"SELECT doc_id, path FROM (SELECT * FROM ({duck(_LISTED)}) ORDER BY path LIMIT 500) WHERE doc_id IN (SELECT o_custkey FROM orders) AND doc_id % 5 <> 0")
def resume_filter(spark, sf_dir):
    listed = rows(spark, sf_dir, _LISTED)
    return extract.pending(listed, rows(spark, sf_dir, "SELECT o_custkey AS doc_id FROM {orders}"), listed.where("doc_id % 5 = 0"), limit=500)


@query("first_processed", f"SELECT doc_id, path FROM ({duck(_LISTED)}) WHERE doc_id % 5 <> 0 ORDER BY path LIMIT 7")
def first_processed(spark, sf_dir):
    listed = rows(spark, sf_dir, _LISTED)
    return extract.first_processed(listed, listed.where("doc_id % 5 = 0"), 7)


@query("load_counters", "SELECT l_linestatus AS file, count(DISTINCT l_orderkey) AS n_docs, count(*) AS n_rows FROM lineitem GROUP BY 1")
def load_counters(spark, sf_dir):
    return rows(spark, sf_dir, "SELECT l_linestatus AS file, l_orderkey FROM {lineitem}").groupBy("file").agg(F.count_distinct("l_orderkey").alias("n_docs"), F.count("*").alias("n_rows"))


@query("llm_mock_extract", "SELECT doc_id, 'not_found' AS status, NULL::DOUBLE AS value_unscaled, true AS has_evidence, substr(sha1('scr_total | 1'), 1, 16) AS snippet_hash FROM documents")
def llm_mock_extract(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("scr_total").alias("field_id"), F.lit(1).alias("start_page"), F.col("text").alias("prompt"))
    return extract.parse_responses(extract.provider("mock")(p)).select("doc_id", "status", "value_unscaled", "has_evidence", "snippet_hash")


@query("html_escape", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text FROM documents")
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.html_escape(F.col("text")).alias("text"))


# --- without SQL: parsers and file round trips ---------------------------------------------------
@query("toc_items")
def toc_items(spark, sf_dir):
    s = rows(spark, sf_dir, "SELECT CAST(p_partkey % 40 AS STRING) AS doc_id, CAST(p_partkey % 6 AS INT) AS page_index, CAST(p_partkey AS INT) AS span_seq, concat(substr('ABCDE', CAST(p_partkey % 5 + 1 AS INT), 1), '.', CAST(p_partkey % 9 + 1 AS STRING), ' ', p_name, ' .... ', CAST(p_size AS STRING)) AS text, CAST(50 AS DOUBLE) AS x0, CAST(p_partkey % 700 AS DOUBLE) AS y0 FROM {part}")
    return toc.items(toc.lines(s))


@query("json_roundtrip", f"SELECT doc_id::VARCHAR AS doc_id, field_id, value AS value_canonical, unit, verified FROM ({_LATEST})")
def json_roundtrip(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    out = f"{shared.rstrip('/')}/extractions-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="ledgerlens-")
    files.write_jsonl(latest(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "field_id", F.lit("ok").alias("status"), "verified", F.col("value").alias("value_canonical"), "unit"), out)
    back = spark.read.schema(files.EXTRACTIONS).json(out)
    return back.select("doc_id", "field_id", "value_canonical", "unit", "verified")
