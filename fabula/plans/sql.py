"""Shared pieces of the SQL twins."""

from __future__ import annotations

from ..functions.text import DASHES, NUMBER_WORDS, TITLES, UNIT_DAYS
from ..sources.derived import KINDS, UNITS


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(x: str) -> str:
    return f"replace(lower(trim(regexp_replace(translate({x}, '{DASHES}’', '{'-' * len(DASHES)}'''), '\\s+', ' ', 'g'))), 'ß', 'ss')"


def strip(k: str) -> str:
    titles = "|".join(t.replace(".", r"\.") for t in TITLES)
    bare = f"trim(regexp_replace(regexp_replace({k}, '^(l''|le |la |les )', ''), '^({titles}) ', ''))"
    return f"CASE WHEN {bare} <> '' AND {bare} <> {k} THEN {bare} END"


JOURNAL = """j AS (SELECT event_id + 1 AS assertion_id, 'user ' || user_id AS entity, CASE WHEN k % 7 = 0 THEN 'hub ' || event_type END AS target, event_type AS attribute,
  CAST(k AS VARCHAR) AS value, CASE WHEN k >= 5 THEN CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) END AS rank
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

TIMELINES = """m AS (SELECT o_custkey AS graph_id, o_orderkey AS moment_id, CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT graph_id, p AS source_id, CASE WHEN d = pd THEN 'simultané' ELSE 'avant' END AS relation, moment_id AS target_id, CASE WHEN d > pd THEN CAST(d - pd AS DOUBLE) END AS gap_days
  FROM (SELECT *, lag(moment_id) OVER w AS p, lag(d) OVER w AS pd FROM m WINDOW w AS (PARTITION BY graph_id ORDER BY d, moment_id)) WHERE p IS NOT NULL)"""

MODELS = """ent AS (SELECT l_returnflag AS model, ascii(l_returnflag) AS priority, l_orderkey AS seq, 's' || l_suppkey AS entity, 'supplier' AS type FROM lineitem
  UNION ALL SELECT l_returnflag, ascii(l_returnflag), l_orderkey, 'p' || l_partkey, 'part' FROM lineitem),
rel AS (SELECT l_returnflag AS model, l_linestatus AS name, 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"""

MENTIONS = """men AS (SELECT c_custkey AS seq, CASE c_custkey % 6 WHEN 0 THEN 'M. ' || c_name WHEN 1 THEN 'Mme  ' || c_name WHEN 2 THEN 'l’inspecteur ' || c_name
  WHEN 3 THEN replace(c_name, '#', chr(8209)) WHEN 4 THEN upper(c_name) ELSE '  ' || c_name || ' ' END AS name, lower(c_mktsegment) AS type FROM customer),
kno AS (SELECT c_custkey AS id, unnest(CASE WHEN c_custkey % 10 = 0 THEN ['M. ', 'Mme '] WHEN c_custkey % 2 = 0 THEN ['Dr '] ELSE [''] END) || c_name AS name FROM customer)"""

SCENES = f"""sc AS (SELECT conv_id AS graph_id, turn // 4 AS chunk_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS moment_id, 'm' || (turn % 2) AS ref,
  CASE turn % 3 WHEN 0 THEN 'm' || (turn % 2) WHEN 1 THEN 'M' || turn END AS target, {listed(KINDS)}[turn % 5 + 1] AS kind, role AS entity, CASE WHEN turn % 4 = 1 THEN CAST(turn AS DOUBLE) END AS gap_days FROM conversations),
refs AS (SELECT graph_id, moment_id, nullif(coalesce(loc, CASE WHEN n BETWEEN 1 AND moment_id THEN n END), moment_id) AS target_id FROM (
  SELECT a.graph_id, a.moment_id, max(b.moment_id) AS loc, any_value(TRY_CAST(nullif(regexp_extract(coalesce(a.target, ''), '^M(\\d+)$', 1), '') AS BIGINT)) AS n
  FROM sc a LEFT JOIN sc b ON a.graph_id = b.graph_id AND a.chunk_index = b.chunk_index AND b.ref = a.target AND b.moment_id < a.moment_id GROUP BY a.graph_id, a.moment_id))"""

REFERENCE = """ref AS (SELECT n_name AS entry, n_nationkey AS entry_no, CASE WHEN n_nationkey % 3 = 0 THEN 'optional' ELSE 'core' END AS level, unnest([n_name, 'la ' || lower(n_name)]) AS variant FROM nation)"""

PARTITION = "part2 AS (SELECT doc_id AS key, source AS pred, lang AS gold FROM documents)"
