"""Queries for the reference's operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx
from ..operators import ensemble, metrics, resolve, state, timeline
from ..sources import derived as src
from ..sources.derived import table
from . import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


J, T, M, N, S, R = (f"WITH {x}" for x in (sql.JOURNAL, sql.TIMELINES, sql.MODELS, sql.MENTIONS, sql.SCENES, sql.REFERENCE))
NK, NS = sql.norm("name"), sql.strip("k")

# Sources and scalar functions ------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS n FROM documents")
def q_scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").alias("n"))


def _chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.split_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 500).alias("c"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, x, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS cur, CAST([] AS VARCHAR[]) AS done FROM documents UNION ALL
  SELECT r.doc_id, p.i, CASE WHEN p.n > 500 THEN NULL WHEN r.cur IS NULL OR length(r.cur) + 2 + p.n > 500 THEN p.x ELSE r.cur || chr(10) || chr(10) || p.x END,
    CASE WHEN p.n > 500 THEN list_concat(CASE WHEN r.cur IS NULL THEN r.done ELSE list_append(r.done, r.cur) END, list_transform(range(0, (p.n + 499) // 500), lambda k: substr(p.x, k * 500 + 1, 500))) WHEN r.cur IS NOT NULL AND length(r.cur) + 2 + p.n > 500 THEN list_append(r.done, r.cur) ELSE r.done END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
f AS (SELECT doc_id, arg_max(CASE WHEN cur IS NULL THEN done ELSE list_append(done, cur) END, i) AS c FROM r GROUP BY doc_id)
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_index, unnest(c) AS chunk FROM f""")
def q_chunk_split(spark, d):
    return _chunks(spark, d).select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS cur, CAST(0 AS BIGINT) AS done FROM documents UNION ALL
  SELECT r.doc_id, p.i, CASE WHEN p.n > 500 THEN NULL WHEN r.cur IS NULL OR r.cur + 2 + p.n > 500 THEN p.n ELSE r.cur + 2 + p.n END,
    r.done + CASE WHEN p.n > 500 THEN (r.cur IS NOT NULL)::BIGINT + (p.n + 499) // 500 WHEN r.cur IS NOT NULL AND r.cur + 2 + p.n > 500 THEN 1 ELSE 0 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, CAST(arg_max(done + (cur IS NOT NULL)::BIGINT, i) AS INTEGER) AS n_chunks FROM r GROUP BY doc_id""")
def q_chunk_stats(spark, d):
    return _chunks(spark, d).select("doc_id", F.size("c").alias("n_chunks"))


@query(f"{N} SELECT seq, {NK} AS key FROM men")
def q_normalize_names(spark, d):
    return src.mentions(spark, d).select("seq", fx.normalize_name(F.col("name")).alias("key"))


@query(f"{N} SELECT seq, {NK} AS key FROM men")
def q_normalize_exact(spark, d):
    return src.mentions(spark, d).select("seq", fx.normalize_exact("name").alias("key"))


@query(f"{N}, x AS (SELECT seq, {NK} AS k FROM men) SELECT seq, {NS} AS stripped FROM x")
def q_strip_title(spark, d):
    return src.mentions(spark, d).select("seq", fx.strip_title(fx.normalize_name(F.col("name"))).alias("stripped"))


@query(f"{N}, x AS (SELECT seq, {NK} AS k FROM men) SELECT seq, k AS key FROM x UNION ALL SELECT seq, key FROM (SELECT seq, {NS} AS key FROM x) WHERE key IS NOT NULL")
def q_mention_keys(spark, d):
    return src.mentions(spark, d).select("seq", F.explode(fx.mention_keys(F.col("name"))).alias("key"))


@query(f"WITH x AS (SELECT o_orderkey, o_custkey % 7 - 1 AS v, {sql.listed(src.UNITS)}[o_orderkey % 8 + 1] AS u FROM orders), y AS (SELECT *, CASE regexp_replace(u, 's+$', '') " + " ".join(f"WHEN '{k.rstrip('s')}' THEN {v!r}" for k, v in fx.UNIT_DAYS.items()) + " END AS f FROM x) SELECT o_orderkey, round(CASE WHEN v > 0 THEN v * CAST(f AS DOUBLE) END, 6) AS days FROM y")
def q_gap_to_days(spark, d):
    unit = F.element_at(F.array(*map(F.lit, src.UNITS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.round(fx.gap_to_days(F.col("o_custkey") % 7 - 1, unit), 6).alias("days"))


WORDS = ["la cinquantaine", "trente ans", "inconnu"]


@query(f"WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'vers ' || p_size || ' ans' ELSE {sql.listed(WORDS)}[p_size % 3 + 1] END AS t FROM part) SELECT p_partkey, CASE WHEN regexp_extract(t, '(\\d+)', 1) <> '' THEN CAST(regexp_extract(t, '(\\d+)', 1) AS INTEGER) " + " ".join(f"WHEN contains(t, '{w.rstrip('e')}') THEN {n}" for w, n in fx.NUMBER_WORDS.items()) + " END AS n FROM x")
def q_parse_number(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("vers "), "p_size", F.lit(" ans"))).otherwise(F.element_at(F.array(*map(F.lit, WORDS)), F.col("p_size") % 3 + 1))
    return table(spark, d, "part").select("p_partkey", fx.parse_number(t).alias("n"))


@query("SELECT event_id, props FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '  ' ELSE props END AS props FROM events) WHERE trim(props) <> ''")
def q_sanitize(spark, d):
    e = table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("props")))
    return e.where(F.trim("props") != "").select("event_id", "props")


@query("WITH x AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS hit, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS core FROM customer GROUP BY c_nationkey), y AS (SELECT c_nationkey, hit / n AS p, core / n AS r FROM x) SELECT c_nationkey, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y")
def q_prf(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("hit"), F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("core"))
    return c.select("c_nationkey", *metrics.report(fx.ratio(F.col("hit"), F.col("n")), fx.ratio(F.col("core"), F.col("n"))))


@query(f"{J} SELECT entity, assertion_id, attribute FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY assertion_id DESC) AS n FROM j) WHERE n <= 20")
def q_recent_moments(spark, d):
    w = Window.partitionBy("entity").orderBy(F.desc("assertion_id"))
    return src.journal(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 20").select("entity", "assertion_id", "attribute")


@query("SELECT c_mktsegment, string_agg(c_name, '; ' ORDER BY c_name) FILTER (n <= 5) AS listing FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS n FROM customer) GROUP BY c_mktsegment")
def q_entity_context(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy("c_name")
    top = table(spark, d, "customer").select("c_mktsegment", "c_name", F.row_number().over(w).alias("n")).where("n <= 5")
    return top.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "; ").alias("listing"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'e') AND p_size > 10")
def q_search_filter(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower(F.concat("p_name", F.lit(" "), "p_brand")), F.lit("e")) & (F.col("p_size") > 10)).select("p_partkey", "p_name")


@query("SELECT page_id, replace(html, '<', '\\u003c') AS safe FROM pages")
def q_json_escape(spark, d):
    return table(spark, d, "pages").select("page_id", fx.escape_json_for_html(F.col("html")).alias("safe"))


# Sinks' semantics ------------------------------------------------------------------------------------------------


@query(f"{J} SELECT entity, assertion_id, row_number() OVER (PARTITION BY entity ORDER BY assertion_id) AS local_id FROM j")
def q_surrogate_ids(spark, d):
    return src.journal(spark, d).select("entity", "assertion_id", F.row_number().over(Window.partitionBy("entity").orderBy("assertion_id")).cast("long").alias("local_id"))


@query(f"{J}, x AS (SELECT CASE WHEN target IS NULL THEN entity END AS e, target AS r FROM j) SELECT count(*) AS violations FROM x WHERE (e IS NULL) = (r IS NULL)")
def q_journal_xor_check(spark, d):
    x = src.journal(spark, d).select(F.when(F.col("target").isNull(), F.col("entity")).alias("e"), F.col("target").alias("r"))
    return x.where(F.col("e").isNull() == F.col("r").isNull()).agg(F.count("*").alias("violations"))


@query(f"{J} SELECT entity, attribute, arg_min(value, assertion_id) AS value FROM j WHERE target IS NULL GROUP BY ALL")
def q_first_value_entity(spark, d):
    return state.first_values(src.journal(spark, d).where("target is null"), ["entity"])


@query(f"{J} SELECT entity, target, attribute, arg_min(value, assertion_id) AS value FROM j WHERE target IS NOT NULL GROUP BY ALL")
def q_first_value_relation(spark, d):
    return state.first_values(src.journal(spark, d).where("target is not null"), ["entity", "target"])


@query(f"{S} SELECT graph_id, moment_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM sc GROUP BY ALL")
def q_export_appearances(spark, d):
    return src.scenes(spark, d).groupBy("graph_id", "moment_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("entities"))


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY ALL")
def q_gold_upsert(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("props"))


@query("WITH f AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F') SELECT * FROM n UNION ALL SELECT * FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM n)")
def q_results_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new, old = o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus")
    return new.unionByName(old.join(new, "o_custkey", "left_anti"))


@query(f"{J} SELECT entity, attribute, value, CAST(NULL AS INTEGER) AS rank FROM j WHERE target IS NULL AND rank IS NULL UNION ALL SELECT entity, attribute, value, rank FROM j WHERE rank IS NOT NULL AND target IS NULL")
def q_legacy_undated(spark, d):
    j = src.journal(spark, d).where("target is null")
    old = j.where("rank is null").select("entity", "attribute", "value", F.lit(None).cast("int").alias("rank"))
    return old.unionByName(j.where("rank is not null").select("entity", "attribute", "value", "rank"))


# Identity --------------------------------------------------------------------------------------------------------

_KEYS = f"{N}, m1 AS (SELECT seq, {NK} AS k FROM men), m2 AS (SELECT seq, k, {NS} AS s FROM m1), e1 AS (SELECT DISTINCT {NK} AS k FROM kno), e2 AS (SELECT k, {NS} AS s FROM e1), idx AS (SELECT s, CASE WHEN count(*) = 1 THEN min(k) END AS v FROM e2 WHERE s IS NOT NULL GROUP BY s)"


@query(f"{_KEYS} SELECT seq, coalesce(a.k, idx.v, b.k) AS entity FROM m2 LEFT JOIN e1 a ON a.k = m2.k LEFT JOIN idx ON idx.s = m2.k LEFT JOIN e1 b ON b.k = m2.s")
def q_resolve_mentions(spark, d):
    return resolve.resolve(src.mentions(spark, d), src.known_entities(spark, d)).select("seq", "entity")


@query(f"{_KEYS} SELECT s AS stripped, v AS key FROM idx")
def q_stripped_index(spark, d):
    return resolve.stripped_index(src.known_entities(spark, d))


_DEDUP = f"{N}, x AS (SELECT seq, name, {NK} AS key, CASE WHEN seq % 3 = 0 THEN 'inconnu' ELSE type END AS type FROM men UNION ALL SELECT seq + 1000000, upper(name), {NK}, type FROM men)"


def _entity_rows(spark, d):
    m = src.mentions(spark, d)
    first = m.select("seq", "name", F.when(F.col("seq") % 3 == 0, "inconnu").otherwise(F.col("type")).alias("type"))
    return first.unionByName(m.select((F.col("seq") + 1_000_000).alias("seq"), F.upper("name").alias("name"), "type"))


@query(f"{_DEDUP} SELECT key, arg_min(name, seq) AS name FROM x GROUP BY key")
def q_entity_dedup(spark, d):
    return resolve.dedup_entities(_entity_rows(spark, d)).select("key", "name")


@query(f"{_DEDUP} SELECT key, coalesce(arg_min(type, seq) FILTER (type <> 'inconnu'), 'inconnu') AS type FROM x GROUP BY key")
def q_type_upgrade(spark, d):
    return resolve.dedup_entities(_entity_rows(spark, d)).select("key", "type")


@query()
def q_entity_fold(spark, d):
    rows = _entity_rows(spark, d).withColumn("graph_id", F.col("seq") % 1_000_000 % 97)
    return resolve.fold_entities(rows)


@query(f"{N}, a AS (SELECT seq, {NK} AS key, {sql.norm('type')} || ' ' || (seq % 50) AS alias FROM men) SELECT alias, arg_min(key, seq) AS key FROM a WHERE alias <> key AND alias NOT IN (SELECT {NK} FROM kno) GROUP BY alias")
def q_alias_claims(spark, d):
    a = src.mentions(spark, d).select("seq", "name", F.concat("type", F.lit(" "), (F.col("seq") % 50).cast("string")).alias("alias"))
    return resolve.alias_claims(a, src.known_entities(spark, d)).select("alias", "key")


@query("SELECT lower(l_linestatus) AS name, 's' || l_suppkey AS source, 'p' || l_partkey AS target, min(l_orderkey) AS first_seq FROM lineitem GROUP BY ALL")
def q_relation_dedup(spark, d):
    li = table(spark, d, "lineitem")
    return resolve.dedup_relations(li.select(F.col("l_orderkey").alias("seq"), F.col("l_linestatus").alias("name"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")))


@query(f"{J}, k AS (SELECT DISTINCT rank FROM j WHERE rank % 2 = 0), x AS (SELECT j.entity, attribute, value, k.rank AS moment_id, assertion_id FROM j LEFT JOIN k ON k.rank = j.rank) SELECT entity, attribute, value, moment_id, min(assertion_id) AS assertion_id FROM x GROUP BY ALL")
def q_journal_dedup(spark, d):
    j = src.journal(spark, d).withColumnRenamed("rank", "moment_id")
    return resolve.dedup_journal(j, j.where("moment_id % 2 = 0").select("moment_id"), ["entity"])


@query(f"{S} SELECT graph_id, chunk_index, moment_id, lag(moment_id) OVER (PARTITION BY graph_id ORDER BY moment_id) AS prev FROM sc")
def q_moment_ids(spark, d):
    return src.scenes(spark, d).select("graph_id", "chunk_index", "moment_id", F.lag("moment_id").over(Window.partitionBy("graph_id").orderBy("moment_id")).alias("prev"))


@query(f"{S} SELECT graph_id, moment_id, target_id FROM refs")
def q_resolve_refs(spark, d):
    return timeline.resolve_refs(src.scenes(spark, d)).select("graph_id", "moment_id", "target_id")


_TRANS = f"""{S}, x AS (SELECT sc.*, target_id, lag(sc.moment_id) OVER (PARTITION BY sc.graph_id ORDER BY sc.moment_id) AS prev FROM sc JOIN refs USING (graph_id, moment_id)),
t AS (SELECT graph_id, CASE kind WHEN 'parallèle' THEN CASE WHEN target_id IS NOT NULL THEN moment_id END WHEN 'flashback' THEN CASE WHEN prev IS NOT NULL THEN moment_id END WHEN 'retour' THEN coalesce(target_id, prev) ELSE prev END AS source_id,
  CASE WHEN kind = 'parallèle' THEN 'simultané' ELSE 'avant' END AS relation, CASE kind WHEN 'parallèle' THEN target_id WHEN 'flashback' THEN prev ELSE moment_id END AS target_id, gap_days FROM x)"""


def _transitions(spark, d):
    s = src.scenes(spark, d)
    refs = timeline.resolve_refs(s).select("graph_id", "moment_id", "target_id")
    return timeline.transitions(s.join(refs, ["graph_id", "moment_id"]))


@query(f"{_TRANS} SELECT * FROM t WHERE source_id IS NOT NULL")
def q_transitions(spark, d):
    return _transitions(spark, d)


@query(f"{S} SELECT DISTINCT graph_id, moment_id, entity FROM sc")
def q_appearances(spark, d):
    return src.scenes(spark, d).select("graph_id", "moment_id", "entity").distinct()


_MAP = "map AS (SELECT DISTINCT entity AS member, 'user ' || (CAST(substr(entity, 6) AS BIGINT) // 2 * 2) AS canonical FROM j)"


def _mapping(j):
    return j.select(F.col("entity").alias("member"), F.concat(F.lit("user "), F.floor(F.substring("entity", 6, 20).cast("long") / 2) * 2).alias("canonical")).distinct()


@query(f"{J}, {_MAP} SELECT canonical AS entity, attribute, value, rank AS moment_id, min(assertion_id) AS assertion_id FROM j JOIN map ON member = entity GROUP BY ALL")
def q_adopt_journal(spark, d):
    j = src.journal(spark, d)
    moved = resolve.rename(j, _mapping(j), "entity").withColumnRenamed("rank", "moment_id")
    return resolve.dedup_journal(moved, moved.where("moment_id is not null").select("moment_id"), ["entity"])


@query("WITH m AS (SELECT c_nationkey AS g, c_custkey // 5 AS n, c_custkey AS k, c_name, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_mktsegment) END AS t FROM customer), r AS (SELECT *, arg_min(t, k) FILTER (t IS NOT NULL) OVER (PARTITION BY g, n) AS kind FROM m), h AS (SELECT *, count(*) OVER (PARTITION BY g, n) AS c, arg_min(c_name, k) OVER (PARTITION BY g, n) AS head FROM r WHERE t IS NULL OR t = kind) SELECT g AS graph_id, c_name AS member, head AS canonical FROM h WHERE c >= 2")
def q_merge_groups(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    m = c.select(F.col("c_nationkey").alias("graph_id"), F.floor(k / 5).alias("group_no"), F.lit("none").alias("canonical"), k.alias("member_pos"), F.col("c_name").alias("member"), F.when(k % 4 == 0, "inconnu").otherwise(F.lower("c_mktsegment")).alias("type"))
    return resolve.merge_groups(m)


@query(f"{J}, {_MAP} SELECT canonical, count(*) AS n_members, min(member) AS first_member FROM map GROUP BY canonical")
def q_canonicalize(spark, d):
    return _mapping(src.journal(spark, d)).groupBy("canonical").agg(F.count("*").alias("n_members"), F.min("member").alias("first_member"))


@query(f"{N}, e AS (SELECT id, name, CASE WHEN id % 2 = 0 THEN 'inconnu' ELSE 'lieu' END AS type FROM kno), p AS (SELECT {sql.norm('n_')} AS key, arg_min(t, pos) AS t FROM (SELECT c_name AS n_, c_custkey AS pos, CASE WHEN c_custkey % 4 = 1 THEN 'inconnu' ELSE 'personnage' END AS t FROM customer UNION ALL SELECT 'Dr ' || c_name, c_custkey, 'objet' FROM customer) WHERE t <> 'inconnu' GROUP BY 1) SELECT id, name, CASE WHEN type = 'inconnu' THEN coalesce(t, type) ELSE type END AS type FROM e LEFT JOIN p ON p.key = {NK}")
def q_apply_types(spark, d):
    e = src.known_entities(spark, d).withColumn("type", F.when(F.col("id") % 2 == 0, "inconnu").otherwise("lieu"))
    c = table(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 1, "inconnu").otherwise("personnage").alias("type"))
    p = p.unionByName(c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("Dr "), "c_name").alias("name"), F.lit("objet").alias("type")))
    return resolve.apply_types(e, p).select("id", "name", "type")


@query("SELECT c_nationkey AS graph_id, c_custkey AS pos, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS batch FROM customer")
def q_batches(spark, d):
    return resolve.batches(table(spark, d, "customer").select(F.col("c_nationkey").alias("graph_id"), F.col("c_custkey").alias("pos")), "pos")


@query("WITH a AS (SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS old, round(avg(l_quantity), 6) AS new FROM lineitem GROUP BY l_suppkey) SELECT * FROM a WHERE old IS DISTINCT FROM new")
def q_metric_diff(spark, d):
    q = F.col("l_quantity")
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_returnflag") == "N", q)), 6).alias("old"), F.round(F.avg(q), 6).alias("new"))
    return a.where(~F.col("old").eqNullSafe(F.col("new")))


# Timelines -------------------------------------------------------------------------------------------------------


@query(f"{T} SELECT graph_id, moment_id, min(moment_id) OVER (PARTITION BY graph_id, d) AS block FROM m")
def q_components(spark, d):
    return timeline.simultaneity_blocks(*src.timelines(spark, d))


@query(f"{T} SELECT graph_id, moment_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY d, moment_id) - 1 AS INTEGER) AS resolved_order FROM m")
def q_timeline_order(spark, d):
    return timeline.resolve_timeline(*src.timelines(spark, d)).select("graph_id", "moment_id", "resolved_order")


@query(f"{T} SELECT graph_id, moment_id, CAST(d - min(d) OVER (PARTITION BY graph_id) AS DOUBLE) AS resolved_days FROM m")
def q_timeline_days(spark, d):
    return timeline.resolve_timeline(*src.timelines(spark, d)).select("graph_id", "moment_id", "resolved_days")


@query()
def q_timeline_warnings(spark, d):
    s = src.scenes(spark, d).withColumn("seq", F.col("moment_id"))
    c = _transitions(spark, d)
    c = c.withColumn("constraint_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("source_id", "target_id", "relation")))
    return timeline.resolve_timeline(s, c)


@query(f"{T}, b AS (SELECT graph_id, source_id, CASE WHEN target_id % 11 = 0 THEN 'après' ELSE relation END AS relation, CASE WHEN target_id % 13 = 0 THEN -1 ELSE target_id END AS target_id FROM c) SELECT DISTINCT * FROM b WHERE relation = 'après' OR target_id = -1")
def q_invalid_constraints(spark, d):
    m, c = src.timelines(spark, d)
    c = c.select("graph_id", "source_id", F.when(F.col("target_id") % 11 == 0, "après").otherwise(F.col("relation")).alias("relation"), F.when(F.col("target_id") % 13 == 0, -1).otherwise(F.col("target_id")).alias("target_id"))
    return timeline.invalid_constraints(m, c)


def _both_ways(relations):
    r = relations.select("source", "target").distinct()
    return r.unionByName(r.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


_WAYS = f"{M}, w AS (SELECT source AS a, target AS b FROM rel UNION SELECT target, source FROM rel)"


@query(f"{_WAYS} SELECT a AS node, count(*) AS degree FROM w GROUP BY a")
def q_degree(spark, d):
    return _both_ways(src.models(spark, d)[1]).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))


@query(f"{_WAYS} SELECT a AS node, min(b) AS first_neighbour, max(b) AS last_neighbour FROM w GROUP BY a")
def q_neighbors(spark, d):
    return _both_ways(src.models(spark, d)[1]).groupBy(F.col("source").alias("node")).agg(F.min("target").alias("first_neighbour"), F.max("target").alias("last_neighbour"))


# State -----------------------------------------------------------------------------------------------------------

_LAST = "SELECT {s}, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY {s}, attribute ORDER BY coalesce(rank, -1) DESC, assertion_id) AS n FROM j WHERE target IS {t} {w}) WHERE n = 1"


@query(f"{J} " + _LAST.format(s="entity", t="NULL", w=""))
def q_state_final(spark, d):
    return state.final_state(src.journal(spark, d).where("target is null"), ["entity"])


@query(f"{J} " + _LAST.format(s="entity", t="NULL", w="AND coalesce(rank, -1) <= 10"))
def q_state_at(spark, d):
    return state.final_state(src.journal(spark, d).where("target is null"), ["entity"], at=10)


@query(f"{J} " + _LAST.format(s="entity, target", t="NOT NULL", w=""))
def q_relation_state(spark, d):
    return state.final_state(src.journal(spark, d).where("target is not null"), ["entity", "target"])


@query(f"{J} SELECT entity, rank, count(*) FILTER (target IS NULL) AS n_assertions FROM j WHERE rank IS NOT NULL GROUP BY entity, rank")
def q_track(spark, d):
    j = src.journal(spark, d)
    return state.track(j.where("rank is not null").select("entity", "rank").distinct(), j.where("target is null"))


@query(f"{J}, x AS (SELECT *, lag(value) OVER (PARTITION BY entity, attribute ORDER BY rank, assertion_id) AS before FROM j WHERE rank IS NOT NULL AND target IS NULL) SELECT entity, attribute, CAST(row_number() OVER (PARTITION BY entity, attribute ORDER BY rank, assertion_id) AS INTEGER) AS position, rank, value FROM x WHERE before IS NULL OR before <> value")
def q_history(spark, d):
    return state.history(src.journal(spark, d).where("target is null"), ["entity"])


@query(f"{J} SELECT entity, count(DISTINCT attribute) AS n_attributes, count(*) AS n_assertions FROM j GROUP BY entity")
def q_show(spark, d):
    return src.journal(spark, d).groupBy("entity").agg(F.count_distinct("attribute").alias("n_attributes"), F.count("*").alias("n_assertions"))


@query(f"{J} SELECT entity, target, count(*) AS n FROM j WHERE target IS NOT NULL GROUP BY ALL")
def q_entity_detail(spark, d):
    return src.journal(spark, d).where("target is not null").groupBy("entity", "target").agg(F.count("*").alias("n"))


@query(f"{T} SELECT graph_id, moment_id, row_number() OVER (PARTITION BY graph_id ORDER BY d, moment_id) || '. jour ' || (d - min(d) OVER (PARTITION BY graph_id)) AS line FROM m")
def q_timeline_listing(spark, d):
    r = timeline.resolve_timeline(*src.timelines(spark, d))
    return r.select("graph_id", "moment_id", F.concat((F.col("resolved_order") + 1).cast("string"), F.lit(". jour "), F.round("resolved_days").cast("long").cast("string")).alias("line"))


@query(f"{J}, mm AS (SELECT DISTINCT rank AS as_of FROM j WHERE rank IS NOT NULL), x AS (SELECT mm.as_of, j.*, row_number() OVER (PARTITION BY mm.as_of, entity, attribute ORDER BY coalesce(rank, -1) DESC, assertion_id) AS n FROM mm JOIN j ON coalesce(j.rank, -1) <= mm.as_of WHERE target IS NULL) SELECT as_of, entity, attribute, value, rank AS since FROM x WHERE n = 1")
def q_states(spark, d):
    j = src.journal(spark, d)
    return state.snapshots(j.where("target is null"), j.where("rank is not null").select("rank"), ["entity"])


@query(f"{J} SELECT entity, min(coalesce(rank, -1)) AS first_rank FROM j GROUP BY entity")
def q_visibility(spark, d):
    j = src.journal(spark, d)
    return state.visibility(j, j)


@query(f"{T}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY d, moment_id) - 1 AS rk FROM m) SELECT c.graph_id, CAST(a.rk AS INTEGER) AS rank, c.gap_days FROM c JOIN r a ON a.moment_id = c.source_id JOIN r b ON b.moment_id = c.target_id WHERE gap_days IS NOT NULL AND b.rk = a.rk + 1")
def q_gaps(spark, d):
    m, c = src.timelines(spark, d)
    r = timeline.resolve_timeline(m, c).select("graph_id", "moment_id", "resolved_order")
    a, b = (r.select("graph_id", F.col("moment_id").alias(x), F.col("resolved_order").alias(y)) for x, y in (("source_id", "rank"), ("target_id", "next")))
    g = c.where("relation = 'avant' and gap_days is not null").join(a, ["graph_id", "source_id"]).join(b, ["graph_id", "target_id"]).where("next = rank + 1")
    return g.groupBy("graph_id", "rank").agg(F.max_by("gap_days", "constraint_id").alias("gap_days"))


@query(f"{J}, x AS (SELECT entity, rank, rank - row_number() OVER (PARTITION BY entity ORDER BY rank) AS i FROM (SELECT DISTINCT entity, rank FROM j WHERE rank IS NOT NULL)) SELECT entity, min(rank) AS start, max(rank) AS stop FROM x GROUP BY entity, i")
def q_track_runs(spark, d):
    return state.runs(src.journal(spark, d))


@query(f"{J} SELECT entity, target, string_agg(attribute || '=' || value, ',' ORDER BY assertion_id) AS listing FROM j WHERE target IS NOT NULL GROUP BY ALL")
def q_relation_assertions(spark, d):
    j = src.journal(spark, d).where("target is not null")
    rows = F.array_sort(F.collect_list(F.struct("assertion_id", F.concat("attribute", F.lit("="), "value").alias("t"))))
    return j.groupBy("entity", "target").agg(F.array_join(F.transform(rows, lambda r: r["t"]), ",").alias("listing"))


@query(f"{J}, x AS (SELECT * FROM j WHERE rank IS NOT NULL) SELECT a.assertion_id, CAST(count(DISTINCT b.value) - 1 AS INTEGER) AS n_prior FROM x a JOIN x b ON a.entity = b.entity AND a.attribute = b.attribute AND b.rank <= a.rank GROUP BY a.assertion_id")
def q_prior_values(spark, d):
    return state.prior_values(src.journal(spark, d), ["entity"])


# Ensembles -------------------------------------------------------------------------------------------------------


@query(f"{M} SELECT entity, arg_min(type, priority) AS type, min(priority) AS priority FROM ent GROUP BY entity")
def q_merge_union(spark, d):
    return ensemble.merge_union(src.models(spark, d)[0])


@query(f"{M} SELECT entity, count(DISTINCT model) AS votes FROM ent GROUP BY entity")
def q_entity_votes(spark, d):
    return ensemble.entity_votes(src.models(spark, d)[0])


@query(f"{M} SELECT source, target, count(DISTINCT model) AS votes FROM rel GROUP BY ALL")
def q_relation_votes(spark, d):
    return ensemble.relation_votes(src.models(spark, d)[1])


@query(f"{M}, k AS (SELECT entity FROM ent GROUP BY entity HAVING count(DISTINCT model) >= 2), p AS (SELECT source, target FROM rel GROUP BY ALL HAVING count(DISTINCT model) >= 2) SELECT DISTINCT name, source, target FROM rel JOIN p USING (source, target) WHERE source IN (SELECT entity FROM k) AND target IN (SELECT entity FROM k)")
def q_merge_vote(spark, d):
    return ensemble.merge_vote(*src.models(spark, d))[1].select("name", "source", "target")


@query(f"{M}, e AS (SELECT entity AS label, min((priority, seq)) AS k FROM ent GROUP BY entity HAVING count(DISTINCT model) < 3), r AS (SELECT source, target, string_agg(DISTINCT name, ' / ' ORDER BY name) AS names FROM rel GROUP BY ALL HAVING count(DISTINCT model) < 3) SELECT 'R' || (row_number() OVER (ORDER BY source, target) - 1) AS id, source || ' ' || names || ' ' || target AS label FROM r UNION ALL SELECT 'E' || (row_number() OVER (ORDER BY k, label) - 1), label FROM e")
def q_disputed(spark, d):
    return ensemble.disputed(*src.models(spark, d), 3)


@query(f"{M}, a AS (SELECT entity FROM ent GROUP BY entity HAVING count(DISTINCT model) >= 3), v AS (SELECT source, target, count(DISTINCT model) AS n FROM rel GROUP BY ALL), p AS (SELECT source, target FROM v WHERE n >= 3 OR (n = 2 AND source < 's5')) SELECT entity FROM a UNION SELECT source FROM p UNION SELECT target FROM p")
def q_merge_arbitrated(spark, d):
    e, r = src.models(spark, d)
    kept = ensemble.relation_votes(r).where("votes = 2 and source < 's5'").select("source", "target")
    return ensemble.merge_arbitrated(e, r, e.limit(0), kept, 3)[0]


# Evaluation ------------------------------------------------------------------------------------------------------

_CELLS = f"WITH {sql.PARTITION}, c AS (SELECT pred, gold, count(*) AS n FROM part2 GROUP BY ALL), cell AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS np, sum(n) OVER (PARTITION BY gold) AS ng FROM c)"
_F1 = "round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"


def _partition(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("pred"), F.col("lang").alias("gold"))


@query(f"{_CELLS}, s AS (SELECT sum(n * n / np) / sum(n) AS p, sum(n * n / ng) / sum(n) AS r FROM cell) SELECT {_F1} FROM s")
def q_bcubed(spark, d):
    return metrics.bcubed(_partition(spark, d))


_LEA = "SELECT sum({s} * k / CASE WHEN {s} = 1 THEN 1 ELSE {s} * ({s} - 1) / 2 END) / sum({s}) FROM (SELECT {o}, any_value({s}) AS {s}, sum(CASE WHEN {s} = 1 THEN CASE WHEN {x} = 1 THEN 1.0 ELSE 0.0 END ELSE n * (n - 1) / 2 END) AS k FROM cell GROUP BY {o})"


@query(f"{_CELLS}, s AS (SELECT ({_LEA.format(s='np', x='ng', o='pred')}) AS p, ({_LEA.format(s='ng', x='np', o='gold')}) AS r) SELECT {_F1} FROM s")
def q_lea(spark, d):
    return metrics.lea(_partition(spark, d))


def _orders_partition(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_orderkey").cast("string").alias("o"), F.concat("l_orderkey", F.lit("/"), "l_returnflag").alias("f"))


_PAIRS = "WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey AS o, l_returnflag AS f FROM lineitem) SELECT a.key AS a, b.key AS b FROM x a JOIN x b ON a.o = b.o AND a.key < b.key AND a.f <> b.f"


@query(_PAIRS)
def q_over_merged(spark, d):
    return metrics.confusion_pairs(_orders_partition(spark, d).select("key", F.col("o").alias("pred"), F.col("f").alias("gold")))


@query(_PAIRS)
def q_under_merged(spark, d):
    return metrics.confusion_pairs(_orders_partition(spark, d).select("key", F.col("f").alias("pred"), F.col("o").alias("gold")), over=False)


@query("SELECT c_custkey AS entity_id, 'name' AS kind, c_name AS form, c_mktsegment AS type FROM customer UNION ALL SELECT c_custkey, 'alias', 'client ' || c_custkey, c_mktsegment FROM customer")
def q_surface_forms(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_custkey").alias("entity_id"), F.lit("name").alias("kind"), F.col("c_name").alias("form"), F.col("c_mktsegment").alias("type"))
    return names.unionByName(c.select(F.col("c_custkey").alias("entity_id"), F.lit("alias").alias("kind"), F.concat(F.lit("client "), "c_custkey").alias("form"), F.col("c_mktsegment").alias("type")))


@query(f"{_CELLS}, s AS (SELECT sum(n * n / np) / sum(n) AS p, sum(n * n / ng) / sum(n) AS r, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT pred) AS n_pred, count(DISTINCT gold) AS n_gold FROM cell) SELECT {_F1}, n, n_pred, n_gold FROM s")
def q_score_report(spark, d):
    rows = _partition(spark, d)
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("pred").alias("n_pred"), F.count_distinct("gold").alias("n_gold"))
    return metrics.bcubed(rows).join(F.broadcast(counts))  # one row each


@query("WITH p AS (SELECT doc_id, text, unnest(string_split(lower(text), 'license')) AS x, generate_subscripts(string_split(lower(text), 'license'), 1) AS i FROM documents), h AS (SELECT doc_id, text, i, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(x) + 7) OVER (PARTITION BY doc_id ORDER BY i) - 7 AS pos FROM p), s AS (SELECT doc_id, text, CAST(greatest(pos - 40, 0) AS INTEGER) AS start, CAST(least(pos + 47, length(text)) AS INTEGER) AS stop FROM h WHERE i < n), f AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), g AS (SELECT *, sum(CASE WHEN e IS NULL OR start > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT doc_id, min(start) AS start, max(stop) AS stop, substr(any_value(text), min(start) + 1, max(stop) - min(start)) AS passage FROM g GROUP BY doc_id, k")
def q_kwic(spark, d):
    return metrics.kwic(table(spark, d, "documents").select("doc_id", "text"), "license")


@query("WITH s AS (SELECT l_suppkey AS key, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) % 3 AS stop FROM lineitem), f AS (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), g AS (SELECT *, sum(CASE WHEN e IS NULL OR start > e THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM f) SELECT key, min(start) AS start, max(stop) AS stop FROM g GROUP BY key, i")
def q_interval_merge(spark, d):
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 3).alias("stop"))
    return metrics.interval_merge(s, "key")


@query(f"{J}, x AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY assertion_id) AS n FROM j) SELECT entity, count(*) AS total, string_agg(attribute, ',' ORDER BY assertion_id) FILTER (n <= 40) AS attributes FROM x GROUP BY entity")
def q_entity_passages(spark, d):
    w = Window.partitionBy("entity").orderBy("assertion_id")
    x = src.journal(spark, d).withColumn("n", F.row_number().over(w))
    rows = F.array_sort(F.collect_list(F.when(F.col("n") <= 40, F.struct("assertion_id", "attribute"))))
    return x.groupBy("entity").agg(F.count("*").alias("total"), F.array_join(F.transform(rows, lambda r: r["attribute"]), ",").alias("attributes"))


@query("SELECT d.doc_id, source, coalesce(l.t = 1, false) AS discarded, l.doc_id IS NOT NULL AS decided FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS t FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def q_candidates(spark, d):
    gold = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"))
    j = table(spark, d, "documents").join(gold, "doc_id", "left")
    return j.select("doc_id", "source", F.coalesce(F.col("t") == 1, F.lit(False)).alias("discarded"), F.col("t").isNotNull().alias("decided"))


_OWN = f"{R}, o AS (SELECT {sql.norm('variant')} AS k, arg_min(entry, entry_no) AS entry, arg_min(level, entry_no) AS level, count(DISTINCT entry) > 1 AS shared FROM ref GROUP BY 1)"


def _owners(spark, d):
    e, _ = src.reference(spark, d)
    return e.groupBy(fx.normalize_name(F.col("variant")).alias("k")).agg(F.min_by("entry", "entry_no").alias("entry"), F.min_by("level", "entry_no").alias("level"), (F.count_distinct("entry") > 1).alias("shared"))


def _found(spark, d):
    p = src.reference(spark, d)[1].withColumn("k", fx.normalize_name(F.col("name")))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), fx.normalize_name(F.col("n_name")).alias("nk"))
    p = p.join(F.broadcast(nations), "c_nationkey").withColumn("k", F.when(F.col("k").startswith("nation "), F.col("nk")).otherwise(F.col("k")))
    return p.join(_owners(spark, d), "k", "left")


_FOUND = f"{_OWN}, f AS (SELECT c_custkey AS entity_id, c_mktsegment, o.entry, o.level FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o.k = CASE WHEN c_custkey % 2 = 0 THEN {sql.norm('n_name')} ELSE {sql.norm('c_name')} END)"


@query(f"{_FOUND} SELECT entity_id, entry FROM f")
def q_reference_match(spark, d):
    return _found(spark, d).select("entity_id", "entry")


@query(f"{_FOUND}, s AS (SELECT count(DISTINCT entry) / count(*) AS p, count(DISTINCT entry) FILTER (level = 'core') / (SELECT count(DISTINCT entry) FROM ref WHERE level = 'core') AS r FROM f) SELECT {_F1} FROM s")
def q_entity_prf(spark, d):
    core = src.reference(spark, d)[0].where("level = 'core'").agg(F.count_distinct("entry").alias("core"))
    s = _found(spark, d).agg(F.count_distinct("entry").alias("hit"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("level") == "core", F.col("entry"))).alias("core_hit")).join(F.broadcast(core))
    return s.select(*metrics.report(fx.ratio(F.col("hit"), F.col("n")), fx.ratio(F.col("core_hit"), F.col("core"))))


_RELP = "WITH p AS (SELECT DISTINCT least(c_nationkey, n) AS a, greatest(c_nationkey, n) AS b FROM (SELECT c_nationkey, CAST(o_orderkey % 25 AS INTEGER) AS n FROM orders JOIN customer ON c_custkey = o_custkey) WHERE c_nationkey <> n), e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, CASE WHEN (x.n_nationkey + y.n_nationkey) % 2 = 0 THEN 'core' ELSE 'optional' END AS level FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)"


@query(f"{_RELP}, s AS (SELECT count(*) FILTER (level IS NOT NULL) AS hits, count(*) AS n, count(*) FILTER (level = 'core') AS ch FROM p LEFT JOIN e USING (a, b)), t AS (SELECT hits / n AS p, ch / (SELECT count(*) FROM e WHERE level = 'core') AS r, hits, n, (SELECT count(*) FROM e WHERE level = 'core') AS c FROM s) SELECT {_F1}, hits, n AS n_predicted, c AS n_core FROM t")
def q_relation_prf(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n = (F.col("o_orderkey") % 25).cast("int")
    p = o.select(F.least("c_nationkey", n).alias("a"), F.greatest("c_nationkey", n).alias("b")).where("a <> b")
    x = table(spark, d, "nation")
    e = x.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(x.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey").where("a < b")
    return metrics.precision_recall(p, e.select("a", "b", F.when((F.col("a") + F.col("b")) % 2 == 0, "core").otherwise("optional").alias("level")), ["a", "b"])


def _merge_check(spark, d):
    """Pairs of customers' spellings (one with a title): do both resolve to the same entity?"""
    r = resolve.resolve(src.mentions(spark, d), src.known_entities(spark, d)).select("seq", "entity")
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), "c_nationkey")
    return r.join(own, "seq").groupBy("c_nationkey").agg(F.min_by("entity", F.when(F.col("entity").isNotNull(), F.col("seq"))).alias("first"), F.max_by("entity", F.when(F.col("entity").isNotNull(), F.col("seq"))).alias("last"))


_RES = f"{_KEYS}, rr AS (SELECT seq, coalesce(a.k, idx.v, b.k) AS entity FROM m2 LEFT JOIN e1 a ON a.k = m2.k LEFT JOIN idx ON idx.s = m2.k LEFT JOIN e1 b ON b.k = m2.s), g AS (SELECT c_nationkey, arg_min(entity, seq) FILTER (entity IS NOT NULL) AS first, arg_max(entity, seq) FILTER (entity IS NOT NULL) AS last FROM rr JOIN customer ON c_custkey = seq GROUP BY c_nationkey)"


@query(f"{_RES} SELECT c_nationkey, coalesce(first = last, false) AS merged FROM g")
def q_required_merges(spark, d):
    return _merge_check(spark, d).select("c_nationkey", F.coalesce(F.col("first") == F.col("last"), F.lit(False)).alias("merged"))


@query(f"{_RES} SELECT count(*) FILTER (first IS NOT NULL AND last IS NOT NULL) AS evaluable, count(*) FILTER (first <> last) AS kept_apart FROM g")
def q_forbidden_merges(spark, d):
    return _merge_check(spark, d).agg(F.count_if(F.col("first").isNotNull() & F.col("last").isNotNull()).alias("evaluable"), F.count_if(F.col("first") != F.col("last")).alias("kept_apart"))


@query("SELECT p_name AS variant, count(DISTINCT p_brand) AS owners FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1 UNION ALL SELECT p_name, 0 FROM part WHERE trim(p_name) = ''")
def q_reference_validate(spark, d):
    p = table(spark, d, "part")
    shared = p.groupBy(F.col("p_name").alias("variant")).agg(F.count_distinct("p_brand").alias("owners")).where("owners > 1")
    return shared.unionByName(p.where(F.trim("p_name") == "").select(F.col("p_name").alias("variant"), F.lit(0).cast("long").alias("owners")))


@query("SELECT count(DISTINCT c_custkey) AS found, (SELECT count(*) FROM customer) AS expected, CAST(count(*) AS BIGINT) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey")
def q_coverage(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    j = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").agg(F.count_distinct("o_custkey").alias("found"), F.count("*").alias("n_orders"))
    return j.join(F.broadcast(c.agg(F.count("*").alias("expected"))))  # one row each


@query("SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 6) AS std, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders GROUP BY o_custkey")
def q_run_stats(spark, d):
    return metrics.run_stats(table(spark, d, "orders"), ["o_custkey"], "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL")
def q_alias_agg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query(f"{T}, s AS (SELECT graph_id, CAST(max(d) - min(d) AS DOUBLE) AS span, sum(gap_days) AS asked FROM m LEFT JOIN (SELECT graph_id AS g, moment_id AS i, gap_days FROM (SELECT graph_id, target_id AS moment_id, gap_days FROM c)) x ON x.g = graph_id AND x.i = moment_id GROUP BY graph_id) SELECT graph_id, span, coalesce(abs(span - asked) <= 0.25 * asked, span = 0) AS good FROM s")
def q_timeline_score(spark, d):
    m, c = src.timelines(spark, d)
    r = timeline.resolve_timeline(m, c).groupBy("graph_id").agg(F.max("resolved_days").alias("span"))
    g = c.groupBy("graph_id").agg(F.sum("gap_days").alias("asked"))
    return r.join(g, "graph_id", "left").select("graph_id", "span", F.coalesce(F.abs(F.col("span") - F.col("asked")) <= 0.25 * F.col("asked"), F.col("span") == 0).alias("good"))
