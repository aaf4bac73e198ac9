"""Graph tables made from the driver's tables: journals, timelines, models, mentions, scenes, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ["ans", "années", "jours", "semaines", "mois", "heures", "lustres", "nuit"]
KINDS = ["suite", "ellipse", "flashback", "retour", "parallèle"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: assertions of a user's attribute; undated where k < 5; about a relation to a hub where k % 7 = 0."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.select((F.col("event_id") + 1).alias("assertion_id"), F.concat(F.lit("user "), "user_id").alias("entity"), F.when(F.col("k") % 7 == 0, F.concat(F.lit("hub "), "event_type")).alias("target"), F.col("event_type").alias("attribute"), F.col("k").cast("string").alias("value"), F.when(F.col("k") >= 5, day).alias("rank"))


def timelines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders: a graph for each customer; moments in order of key, constraints between neighbours in time."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("moment_id"), F.col("o_orderdate").cast("date").alias("d"))
    w = Window.partitionBy("graph_id").orderBy("d", "moment_id")
    n = o.withColumn("p", F.lag("moment_id").over(w)).withColumn("pd", F.lag("d").over(w)).where("p is not null")
    gap = F.datediff("d", "pd")
    constraints = n.select("graph_id", F.col("moment_id").alias("constraint_id"), F.col("p").alias("source_id"), F.when(gap == 0, "simultané").otherwise("avant").alias("relation"), F.col("moment_id").alias("target_id"), F.when(gap > 0, gap.cast("double")).alias("gap_days"))
    return o.select("graph_id", "moment_id", F.lit(0).alias("chunk_index"), F.col("moment_id").alias("seq")), constraints


def models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem: a model for each return flag; suppliers and parts are entities, pairs are relations named by status."""
    li = table(spark, sf_dir, "lineitem")
    pos = F.ascii("l_returnflag")
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    ends = F.explode(F.array(F.struct(s.alias("entity"), F.lit("supplier").alias("type")), F.struct(p.alias("entity"), F.lit("part").alias("type"))))
    entities = li.select(F.col("l_returnflag").alias("model"), pos.alias("priority"), F.col("l_orderkey").alias("seq"), ends.alias("x")).select("model", "priority", "seq", "x.entity", "x.type")
    relations = li.select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("name"), s.alias("source"), p.alias("target"))
    return entities, relations


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' names, written in six ways."""
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    name = F.when(k == 0, F.concat(F.lit("M. "), n)).when(k == 1, F.concat(F.lit("Mme  "), n)).when(k == 2, F.concat(F.lit("l’inspecteur "), n)).when(k == 3, F.replace(n, F.lit("#"), F.lit("‑"))).when(k == 4, F.upper(n)).otherwise(F.concat(F.lit("  "), n, F.lit(" ")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), name.alias("name"), F.lower("c_mktsegment").alias("type"))


def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an entity, titled or not; every tenth has a namesake with another title."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    titles = F.when(k % 10 == 0, F.array(F.lit("M. "), F.lit("Mme "))).when(k % 2 == 0, F.array(F.lit("Dr "))).otherwise(F.array(F.lit("")))
    return c.select(k.alias("id"), "c_name", F.explode(titles).alias("t")).select("id", F.concat("t", "c_name").alias("name"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: moments of a graph for each conversation, four turns a chunk, with refs and transitions."""
    from pyspark.sql.window import Window

    t = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (t % 5 + 1).cast("int"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    target = F.when(t % 3 == 0, F.concat(F.lit("m"), (t % 2).cast("string"))).when(t % 3 == 1, F.concat(F.lit("M"), t.cast("string")))
    rows = table(spark, sf_dir, "conversations").withColumn("moment_id", F.row_number().over(w).cast("long"))
    return rows.select(F.col("conv_id").alias("graph_id"), F.floor(t / 4).cast("long").alias("chunk_index"), "moment_id", F.concat(F.lit("m"), (t % 2).cast("string")).alias("ref"), target.alias("target"), kind.alias("kind"), F.col("role").alias("entity"), F.when(t % 4 == 1, t.cast("double")).alias("gap_days"))


def reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nations as declared entries (core or optional), regions as the predicted graph's view of them."""
    n = table(spark, sf_dir, "nation")
    entries = n.select(F.col("n_name").alias("entry"), F.col("n_nationkey").alias("entry_no"), F.when(F.col("n_nationkey") % 3 == 0, "optional").otherwise("core").alias("level"), F.explode(F.array("n_name", F.concat(F.lit("la "), F.lower("n_name")))).alias("variant"))
    predicted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation "), "c_nationkey")).otherwise(F.col("c_name")).alias("name"), "c_nationkey", "c_mktsegment")
    return entries, predicted
