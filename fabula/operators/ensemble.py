"""Set operations over several models' graphs: union, votes, arbitration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entity_votes(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity").agg(F.count_distinct("model").alias("votes"))


def relation_votes(relations: DataFrame) -> DataFrame:
    """Votes for each oriented pair, whatever the predicate."""
    return relations.groupBy("source", "target").agg(F.count_distinct("model").alias("votes"))


def merge_union(entities: DataFrame) -> DataFrame:
    """entities (model, priority, seq, entity, type): the first by priority wins."""
    return entities.groupBy("entity").agg(F.min_by("type", F.struct("priority", "seq")).alias("type"), F.min("priority").alias("priority"))


def merge_vote(entities: DataFrame, relations: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Entities and all predicates of pairs with enough votes; both ends must be kept."""
    kept = entity_votes(entities).where(F.col("votes") >= least).select("entity")
    pairs = relation_votes(relations).where(F.col("votes") >= least).select("source", "target")
    rows = relations.select("name", "source", "target").distinct().join(pairs, ["source", "target"], "left_semi")
    for end in ("source", "target"):
        rows = rows.join(kept.select(F.col("entity").alias(end)), end, "left_semi")
    return kept, rows


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``no``, from 0, in the order of ``group`` and then ``order``. Only the groups' counts meet in one task."""
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(*group).agg(F.count("*").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return own.join(offset, group).withColumn("no", F.col("_before") + F.col("_own") - 1).drop("_n", "_before", "_own")


def disputed(entities: DataFrame, relations: DataFrame, models: int) -> DataFrame:
    """Items that not all models have: E-ids by first appearance, R-ids by pair, with the names of all predicates."""
    first = entities.groupBy("entity").agg(F.min(F.struct("priority", "seq")).alias("first"))
    e = entity_votes(entities).where(F.col("votes") < models).join(first, "entity").select("entity", "first.priority", "first.seq", F.floor(F.col("first.seq") / 10_000).alias("part"))
    e = numbered(e, ["priority", "part"], ["seq", "entity"]).select(F.concat(F.lit("E"), "no").alias("id"), F.col("entity").alias("label"))
    r = relations.groupBy("source", "target").agg(F.count_distinct("model").alias("votes"), F.array_join(F.array_sort(F.collect_set("name")), " / ").alias("names")).where(F.col("votes") < models)
    r = numbered(r, ["source"], ["target"]).select(F.concat(F.lit("R"), "no").alias("id"), F.concat_ws(" ", "source", "names", "target").alias("label"))
    return e.unionByName(r)


def merge_arbitrated(entities: DataFrame, relations: DataFrame, keep_entities: DataFrame, keep_pairs: DataFrame, models: int) -> tuple[DataFrame, DataFrame]:
    """What all models agree on, and what the arbiter keeps; ends of every kept pair come back."""
    agreed = entity_votes(entities).where(F.col("votes") >= models).select("entity")
    pairs = relation_votes(relations).where(F.col("votes") >= models).select("source", "target").unionByName(keep_pairs).distinct()
    ends = pairs.select(F.explode(F.array("source", "target")).alias("entity"))
    return agreed.unionByName(keep_entities.select("entity")).unionByName(ends).distinct(), pairs
