"""Identity: titles, aliases, deduplication, and the order-dependent folds per graph."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_name, strip_title
from .grouped import map_groups

UNKNOWN = "inconnu"


def stripped_index(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """entities (name), aliases (alias, name): stripped form and the key of the only entity that has it, else null."""
    keyed = entities.select(normalize_name(F.col("name")).alias("form")).withColumn("key", F.col("form"))
    if aliases is not None:
        keyed = keyed.unionByName(aliases.select(normalize_name(F.col("alias")).alias("form"), normalize_name(F.col("name")).alias("key")))
    keyed = keyed.withColumn("stripped", strip_title(F.col("form"))).where("stripped is not null")
    return keyed.groupBy("stripped").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("stripped", F.when(F.col("low") == F.col("high"), F.col("low")).alias("key"))


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Adds ``entity`` (a key) to mentions, by priority: the entity that the key is an alias of, the key's own entity; the
    stripped index; the mention's own stripped form. A form that several entities share resolves to none. ``aliases``
    (alias, name) are claimed once each (``alias_claims``)."""
    keys = entities.select(normalize_name(F.col("name")).alias("v")).distinct()
    keys = keys.select(F.col("v").alias("k"), "v")
    if aliases is not None:
        claimed = aliases.select(normalize_name(F.col("alias")).alias("k"), normalize_name(F.col("name")).alias("v")).distinct()
        claimed = claimed.join(keys.select("v"), "v", "left_semi").select("k", "v")
        keys = claimed.unionByName(keys.join(claimed, "k", "left_anti"))
    index = stripped_index(entities, aliases)
    m = mentions.withColumn("_k", normalize_name(F.col(name))).withColumn("_s", strip_title(F.col("_k")))
    m = m.join(keys.select(F.col("k").alias("_k"), F.col("v").alias("_1")), "_k", "left")
    m = m.join(index.select(F.col("stripped").alias("_k"), F.col("key").alias("_2")), "_k", "left")
    m = m.join(keys.select(F.col("k").alias("_s"), F.col("v").alias("_3")), "_s", "left")
    return m.withColumn("entity", F.coalesce("_1", "_2", "_3")).drop("_k", "_s", "_1", "_2", "_3")


def dedup_entities(rows: DataFrame) -> DataFrame:
    """rows (seq, name, type) -> key, the first name, the first real type. Names must not be blank."""
    key, kind = normalize_name(F.col("name")), F.lower(F.trim("type"))
    real = F.when((kind != "") & (kind != UNKNOWN), kind)
    keyed = rows.select("seq", "name", key.alias("key"), real.alias("real")).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.coalesce(F.min_by("real", F.when(F.col("real").isNotNull(), F.col("seq"))), F.lit(UNKNOWN)).alias("type"))


def alias_claims(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """aliases (seq, name, alias): each alias goes to its first claimant; entity keys, own names and blanks are no aliases."""
    keyed = aliases.select("seq", normalize_name(F.col("name")).alias("key"), normalize_name(F.col("alias")).alias("alias"))
    keyed = keyed.where("alias <> '' and alias <> key")
    keys = entities.select(normalize_name(F.col("name")).alias("alias")).distinct()
    return keyed.join(keys, "alias", "left_anti").groupBy("alias").agg(F.min_by("key", "seq").alias("key"))


def dedup_relations(rows: DataFrame) -> DataFrame:
    """rows (seq, name, source, target): one per normalised triple, ids in order of first appearance."""
    keyed = rows.select("seq", *[normalize_name(F.col(c)).alias(c) for c in ("name", "source", "target")]).where("name <> '' and source <> '' and target <> ''")
    return keyed.groupBy("name", "source", "target").agg(F.min("seq").alias("first_seq"))


def dedup_journal(journal: DataFrame, moments: DataFrame, subject: list[str]) -> DataFrame:
    """Unknown moments become null first; then the earliest row of each subject, attribute, value and moment stays."""
    known = journal.join(moments.select(F.col("moment_id").alias("_m")).distinct(), F.col("moment_id") == F.col("_m"), "left").withColumn("moment_id", F.col("_m")).drop("_m")
    return known.groupBy(*subject, "attribute", "value", "moment_id").agg(F.min("assertion_id").alias("assertion_id"))


def fold_entities(rows: DataFrame) -> DataFrame:
    """The exact, order-dependent rule: rows (graph_id, seq, name, type) one after the other, so that a titled name joins
    the bare one before it or the other way round, and a form that two entities claim stays ambiguous."""
    keyed = rows.select("graph_id", "seq", "name", normalize_name(F.col("name")).alias("key"), strip_title(normalize_name(F.col("name"))).alias("bare"), F.lower(F.trim("type")).alias("type"))

    def solve(graph, group):
        names, types, titled = {}, {}, {}
        for _, _, name, key, bare, kind in group:
            kind = kind or UNKNOWN
            own = key if key in names else titled.get(key) or (bare if bare in names else None)
            if not key:
                continue
            if own is None:
                own = key
                names[own], types[own] = name, kind
                if bare:
                    titled[bare] = None if bare in titled and titled[bare] != own else own
            elif types[own] == UNKNOWN:
                types[own] = kind
        return [(graph[0], i, k, names[k], types[k]) for i, k in enumerate(names)]

    kind = dict(rows.dtypes)["graph_id"]
    return map_groups(keyed.where("key is not null"), ["graph_id"], ["seq"], solve, f"graph_id {kind}, entity_id long, key string, name string, type string")


def settle(groups: list[list[tuple]]) -> dict[str, str]:
    """The canonical of each member that merges. A group is a list of (canonical, member, type) in order.

    A member of an earlier group is not free any more; the first real type among the free ones is the group's, and those
    of another real type stay out; fewer than two do not merge; a canonical that is no member gives way to the first.
    """
    heads: dict[str, str] = {}
    for group in groups:
        types: dict[str, str | None] = {}
        for _, member, kind in group:
            if member not in heads:
                types.setdefault(member, kind if kind and kind != UNKNOWN else None)
        real = next((t for t in types.values() if t), None)
        names = [m for m, t in types.items() if t in (None, real)]
        if len(names) > 1:
            head = group[0][0]
            heads.update(dict.fromkeys(names, head if head in names else names[0]))
    return heads


def merge_groups(members: DataFrame) -> DataFrame:
    """members (graph_id, group_no, canonical, member_pos, member, type), resolved: which join which canonical (``settle``)."""

    def solve(graph, rows):
        groups = [[r[2:] for r in own] for _, own in itertools.groupby(rows, key=lambda r: r[1])]
        return [(graph[0], member, head) for member, head in settle(groups).items()]

    kind = dict(members.dtypes)["graph_id"]
    ordered = members.select("graph_id", "group_no", "canonical", "member", "type", "member_pos")
    cut = lambda graph, rows: solve(graph, [r[:5] for r in rows])
    return map_groups(ordered, ["graph_id"], ["group_no", "member_pos"], cut, f"graph_id {kind}, member string, canonical string")


def apply_types(entities: DataFrame, proposals: DataFrame) -> DataFrame:
    """Fills unknown types by the first proposal of each name (pos, name, type)."""
    first = proposals.where((F.col("type") != UNKNOWN) & (F.trim("type") != "")).groupBy(normalize_name(F.col("name")).alias("key")).agg(F.min_by("type", "pos").alias("_t"))
    out = entities.withColumn("key", normalize_name(F.col("name"))).join(first, "key", "left")
    return out.withColumn("type", F.when(F.col("type") == UNKNOWN, F.coalesce("_t", "type")).otherwise(F.col("type"))).drop("_t", "key")


def rename(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` through mapping (member, canonical)."""
    m = mapping.select(F.col("member").alias(column), F.col("canonical").alias("_c"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_c", column)).drop("_c")


def batches(rows: DataFrame, order: str, size: int = 50, key: str = "graph_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
