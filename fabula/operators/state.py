"""State, history and tracks from an append-only journal of dated assertions.

A journal has assertion_id (its order), the subject's key columns, attribute, value and rank: the story rank of its
moment, null if undated. Undated rows count as rank -1, before every moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDATED = -1
FOREVER = 2**31 - 1


def rank() -> Column:
    return F.coalesce(F.col("rank"), F.lit(UNDATED))


def first_values(journal: DataFrame, subject: list[str]) -> DataFrame:
    """The earliest value in the journal of each subject and attribute."""
    return journal.where("attribute <> ''").groupBy(*subject, "attribute").agg(F.min_by("value", "assertion_id").alias("value"))


def final_state(journal: DataFrame, subject: list[str], at: int | None = None) -> DataFrame:
    """The value of the latest rank (up to ``at``); within a rank the earliest in the journal."""
    rows = journal.where("attribute <> ''")
    if at is not None:
        rows = rows.where(rank() <= at)
    return rows.groupBy(*subject, "attribute").agg(F.max_by("value", F.struct(rank(), -F.col("assertion_id"))).alias("value"))


def history(journal: DataFrame, subject: list[str]) -> DataFrame:
    """Dated values in story order, without repeats of the value before: position, rank, value."""
    w = Window.partitionBy(*subject, "attribute").orderBy("rank", "assertion_id")
    rows = journal.where("rank is not null and attribute <> ''").withColumn("before", F.lag("value").over(w))
    rows = rows.where(~F.col("value").eqNullSafe(F.col("before")) | F.col("before").isNull())
    return rows.select(*subject, "attribute", F.row_number().over(w).alias("position"), "rank", "value")


def snapshots(journal: DataFrame, moments: DataFrame, subject: list[str]) -> DataFrame:
    """The state at every moment (a column ``rank``): values hold from their rank until the attribute's next one.

    An interval join on bucketed ranks: each interval is cut at bucket edges, so that it is an equi-join that neither
    broadcasts nor compares all pairs.
    """
    w = Window.partitionBy(*subject, "attribute").orderBy("low")
    held = journal.where("attribute <> ''").groupBy(*subject, "attribute", rank().alias("low")).agg(F.min_by("value", "assertion_id").alias("value"))
    held = held.withColumn("high", F.coalesce(F.lead("low").over(w), F.lit(FOREVER)))
    width = 16
    at = moments.select(F.col("rank").alias("as_of")).distinct().withColumn("b", F.floor(F.col("as_of") / width))
    top = at.agg(F.max("b").alias("top"))
    cut = held.join(F.broadcast(top)).withColumn("b", F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0)) / width), F.greatest(F.floor(F.greatest("low", F.lit(0)) / width), F.least(F.floor((F.col("high") - 1) / width), F.col("top"))))))
    return cut.join(at, "b").where("low <= as_of and as_of < high").select("as_of", *subject, "attribute", "value", F.nullif(F.col("low"), F.lit(UNDATED)).alias("since"))


def track(appearances: DataFrame, journal: DataFrame) -> DataFrame:
    """Moments where an entity appears or is the subject of a dated assertion: entity, rank, n_assertions."""
    dated = journal.where("rank is not null").groupBy("entity", "rank").agg(F.count("*").alias("n"))
    there = appearances.select("entity", "rank", F.lit(0).cast("long").alias("n"))
    return dated.unionByName(there).groupBy("entity", "rank").agg(F.sum("n").alias("n_assertions"))


def visibility(subjects: DataFrame, traces: DataFrame, key: str = "entity") -> DataFrame:
    """First trace of each subject: its smallest rank over all traces, -1 without any."""
    first = traces.groupBy(key).agg(F.min(rank()).alias("first_rank"))
    return subjects.select(key).distinct().join(first, key, "left").select(key, F.coalesce("first_rank", F.lit(UNDATED)).alias("first_rank"))


def runs(points: DataFrame, key: str = "entity") -> DataFrame:
    """Maximal runs of consecutive ranks of each key: start, stop."""
    w = Window.partitionBy(key).orderBy("rank")
    island = points.where("rank is not null").select(key, "rank").distinct().withColumn("island", F.col("rank") - F.row_number().over(w))
    return island.groupBy(key, "island").agg(F.min("rank").alias("start"), F.max("rank").alias("stop")).drop("island")


def prior_values(journal: DataFrame, subject: list[str]) -> DataFrame:
    """For each dated row how many different other values its attribute had at its rank or before.

    A value counts from the first rank that has it, so a running sum of first occurrences by rank gives the number.
    """
    dated = journal.where("rank is not null and attribute <> ''")
    first = dated.groupBy(*subject, "attribute", "value").agg(F.min("rank").alias("rank")).groupBy(*subject, "attribute", "rank").agg(F.count("*").alias("new"))
    w = Window.partitionBy(*subject, "attribute").orderBy("rank")
    points = dated.select(*subject, "attribute", "rank").distinct().alias("p").join(first.alias("f"), [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*subject, "attribute", "rank")], "left").select("p.*", "new")
    known = points.select(*[F.col(c).alias(f"_{c}") for c in (*subject, "attribute", "rank")], F.sum(F.coalesce("new", F.lit(0))).over(w).alias("known"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*subject, "attribute", "rank")]
    return dated.join(known, on).select("assertion_id", (F.col("known") - 1).cast("int").alias("n_prior"))
