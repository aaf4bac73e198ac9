"""Queries over whole graphs that are built from ``conversations``: extraction, stores, refinement, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, present, refine
from ..sources import backends, stores
from ..sources import derived as src
from . import sql
from .graph import _TRANS, query

S = f"WITH {sql.SCENES}"
E = f"{S}, ent AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY min(moment_id)) AS id, entity AS name FROM sc GROUP BY graph_id, entity)"
#: In conversations that have both, user is one with assistant.
MERGED = f"{S}, two AS (SELECT graph_id FROM sc WHERE entity IN ('user', 'assistant') GROUP BY graph_id HAVING count(DISTINCT entity) = 2), x AS (SELECT sc.graph_id, sc.moment_id, CASE WHEN two.graph_id IS NOT NULL AND entity = 'user' THEN 'assistant' ELSE entity END AS entity FROM sc LEFT JOIN two USING (graph_id))"


def payloads(spark, d):
    """A recorded reply for each chunk of a conversation."""
    s = src.scenes(spark, d)
    transition = F.struct(F.col("kind").alias("type"), "target", F.lit("").alias("gap_text"), F.col("gap_days").alias("gap_value"), F.lit("jours").alias("gap_unit"))
    fact = F.struct("entity", F.lit("turn").alias("attribute"), F.col("ref").alias("value"))
    moment = F.struct("moment_id", "ref", F.concat(F.lit("s"), "moment_id").alias("summary"), transition.alias("transition"), F.array("entity").alias("entities_present"), F.array(fact).alias("facts"))
    return s.groupBy("graph_id", "chunk_index").agg(F.to_json(F.struct(F.array_sort(F.collect_list(moment)).alias("moments"))).alias("payload"))


def whole(spark, d) -> graphs.Graphs:
    return graphs.extracted(payloads(spark, d))


def texts(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return src.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("graph_id")).agg(F.array_join(F.transform(turns, lambda t: F.coalesce(t["text"], F.lit(""))), "\n\n").alias("text"))


@query(f"{E} SELECT graph_id, id, name, 'inconnu' AS type FROM ent")
def q_extract_entities(spark, d):
    return whole(spark, d)["entities"]


@query(f"{S} SELECT graph_id, moment_id AS id, chunk_index, row_number() OVER (PARTITION BY graph_id, chunk_index ORDER BY moment_id) - 1 AS seq, 's' || moment_id AS summary FROM sc")
def q_extract_moments(spark, d):
    return whole(spark, d)["moments"].drop("resolved_order", "resolved_days")


@query(f"{_TRANS} SELECT graph_id, source_id, relation, target_id, gap_days FROM t WHERE source_id IS NOT NULL")
def q_extract_constraints(spark, d):
    return whole(spark, d)["moment_constraints"].select("graph_id", "source_id", "relation", "target_id", "gap_days")


@query(f"{E} SELECT sc.graph_id, moment_id AS id, ent.id AS entity_id, 'turn' AS attribute, ref AS value, moment_id, chunk_index FROM sc JOIN ent ON ent.graph_id = sc.graph_id AND ent.name = sc.entity")
def q_extract_journal(spark, d):
    return whole(spark, d)["assertions"].drop("relation_id")


@query(f"{E} SELECT sc.graph_id, moment_id, ent.id AS entity_id FROM sc JOIN ent ON ent.graph_id = sc.graph_id AND ent.name = sc.entity")
def q_extract_appearances(spark, d):
    return whole(spark, d)["appearances"]


@query(f"{E} SELECT graph_id, 'entities' AS tbl, count(*) AS n FROM ent GROUP BY graph_id UNION ALL SELECT graph_id, unnest(['moments', 'appearances', 'assertions']), count(*) FROM sc GROUP BY graph_id UNION ALL SELECT graph_id, 'moment_constraints', count(*) FROM (SELECT * FROM ({_TRANS} SELECT * FROM t WHERE source_id IS NOT NULL)) GROUP BY graph_id")
def q_sqlite_roundtrip(spark, d):
    return stores.of_files(stores.to_files(whole(spark, d))).rows().groupBy("graph_id", "tbl").agg(F.count("*").alias("n"))


@query("SELECT CAST(NULL AS BIGINT) AS graph_id, CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS BIGINT) AS n WHERE false")
def q_graph_violations(spark, d):
    return whole(spark, d).violations()


@query("WITH x AS (SELECT c_nationkey AS graph_id, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END AS name FROM customer) SELECT graph_id, count(*) FILTER (name = ' ') AS skipped, count(DISTINCT name) FILTER (name <> ' ') AS n_entities FROM x GROUP BY graph_id")
def q_saved_graphs(spark, d):
    name = F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name"))
    one = F.struct("c_custkey", name.alias("name"), F.lower("c_mktsegment").alias("type"))
    saved = src.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("graph_id")).agg(F.array_sort(F.collect_list(one)).alias("e"))
    saved = saved.select("graph_id", F.from_json(F.to_json(F.struct(F.col("e").alias("entities"))), stores.SAVED).alias("s")).select("graph_id", "s.*")
    g, skipped = stores.of_saved(saved)
    return g["entities"].groupBy("graph_id").agg(F.count("*").alias("n_entities")).join(skipped, "graph_id")


@query(f"{MERGED} SELECT graph_id, entity AS name, count(*) AS n_facts FROM x GROUP BY ALL")
def q_canonicalized(spark, d):
    w = whole(spark, d)
    groups = w["entities"].select("graph_id").distinct().select("graph_id", F.lit(0).alias("group_no"), F.lit("assistant").alias("canonical"), F.array(F.lit("user"), F.lit("assistant"), F.lit("nobody")).alias("members"))
    g = graphs.canonicalized(w, groups)
    return g["assertions"].join(g["entities"].select("graph_id", F.col("id").alias("entity_id"), "name"), ["graph_id", "entity_id"]).groupBy("graph_id", "name").agg(F.count("*").alias("n_facts"))


@query(f"{MERGED} SELECT graph_id, 'user' AS alias, 'assistant' AS name FROM two")
def q_alias_windows(spark, d):
    answer = {"groups": [{"canonical": "assistant", "members": ["assistant", "user"]}]}
    g = refine.resolve_aliases(whole(spark, d), texts(spark, d), lambda: backends.Scripted(lambda system, user: answer), window=200)
    return g["entity_aliases"].join(g["entities"].select("graph_id", F.col("id").alias("entity_id"), "name"), ["graph_id", "entity_id"]).select("graph_id", "alias", "name")


@query(f"{S} SELECT graph_id, entity AS name, CASE WHEN entity = 'system' THEN 'objet' ELSE 'personnage' END AS type FROM sc GROUP BY ALL")
def q_refined_types(spark, d):
    def answer(system, user):
        names = user.split("\n", 1)[0].removeprefix("Entities: ").split(", ")
        return {"groups": [], "types": [{"name": n, "type": "objet" if n == "system" else "Personnage"} for n in names[:1]]}

    return refine.refine(whole(spark, d), texts(spark, d), lambda: backends.Scripted(answer))["entities"].select("graph_id", "name", "type")


@query(f"{E} SELECT ent.graph_id, count(*) + 1 AS n_entities, 3 AS n_proposed FROM ent GROUP BY ent.graph_id")
def q_completed(spark, d):
    w = whole(spark, d)
    items = w["entities"].select("graph_id").distinct().select("graph_id", F.lit(0).alias("seq"), F.lit('{"entities": [{"name": "new", "type": "lieu"}, {"name": " "}], "relations": [{"name": "in", "source": "New", "target": ""}]}').alias("payload"))
    g, n = graphs.completed(w, items)
    return g["entities"].groupBy("graph_id").agg(F.count("*").alias("n_entities")).join(n, "graph_id")


@query(f"{S} SELECT DISTINCT graph_id, entity, moment_id FROM sc")
def q_tracks_whole(spark, d):
    return present.all_tracks(whole(spark, d)).select("graph_id", "entity", "moment_id")


@query(f"{E} SELECT graph_id, (SELECT count(*) FROM ent WHERE ent.graph_id = sc.graph_id) AS entities, count(*) AS moments, count(*) AS assertions FROM sc GROUP BY graph_id")
def q_export_json(spark, d):
    n = lambda c: F.json_array_length(F.get_json_object("answer", f"$.{c}")).cast("long").alias(c)
    return present.answered(whole(spark, d), present.export).select("graph_id", n("entities"), n("moments"), n("assertions"))


@query(f"{E} SELECT graph_id, count(*) AS moments, count(*) AS states, (SELECT count(*) FROM ent WHERE ent.graph_id = sc.graph_id) AS tracks FROM sc GROUP BY graph_id")
def q_payload(spark, d):
    n = lambda c: F.json_array_length(F.get_json_object("answer", f"$.{c}")).cast("long").alias(c)
    return present.answered(whole(spark, d), present.payload).select("graph_id", n("moments"), n("states"), n("tracks"))


@query(f"{E} SELECT graph_id, count(*) + count(DISTINCT entity) + 0 * max(moment_id) AS n_lines FROM sc GROUP BY graph_id")
def q_listings(spark, d):
    """Lines of the list of entities (no relations here) without its head, and of the timeline without its trailer."""
    w = whole(spark, d)
    lines = F.size(F.split("answer", "\n")) - 1
    both = present.answered(w, present.show).unionByName(present.answered(w, present.timeline))
    return both.groupBy("graph_id").agg(F.sum(lines).alias("n_lines"))
