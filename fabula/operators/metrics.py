"""Evaluation: clusterings (B3, LEA, confusion pairs), references, runs, keyword in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import f1, links, ratio


def contingency(rows: DataFrame) -> DataFrame:
    """rows (key, pred, gold) -> cells with n, np (the predicted cluster's size) and ng."""
    cells = rows.where("pred is not null and gold is not null").groupBy("pred", "gold").agg(F.count("*").alias("n"))
    return cells.withColumn("np", F.sum("n").over(Window.partitionBy("pred"))).withColumn("ng", F.sum("n").over(Window.partitionBy("gold")))


def report(p: Column, r: Column) -> list[Column]:
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return [F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1(p, r), 6).alias("f1")]


def bcubed(rows: DataFrame) -> DataFrame:
    n = F.col("n")
    sums = contingency(rows).agg(F.sum(n * n / F.col("np")).alias("p"), F.sum(n * n / F.col("ng")).alias("r"), F.sum(n).alias("n"))
    return sums.select(*report(F.col("p") / F.col("n"), F.col("r") / F.col("n")))


def lea(rows: DataFrame) -> DataFrame:
    """Share of each cluster's links that the other side keeps, weighted by size; a single's link is to itself."""
    cells = contingency(rows)

    def side(own: str, size: str, other: str) -> DataFrame:
        kept = F.when(F.col(size) == 1, F.when(F.col(other) == 1, 1.0).otherwise(0.0)).otherwise(F.when(F.col("n") >= 2, F.col("n") * (F.col("n") - 1) / 2.0).otherwise(0.0))
        per = cells.groupBy(own).agg(F.first(size).alias("size"), F.sum(kept).alias("kept"))
        return per.agg((F.sum(F.col("size") * F.col("kept") / links(F.col("size"))) / F.sum("size")).alias("x"))

    p, r = side("pred", "np", "ng").withColumnRenamed("x", "p"), side("gold", "ng", "np").withColumnRenamed("x", "r")
    return p.join(F.broadcast(r)).select(*report(F.col("p"), F.col("r")))  # one row each


def confusion_pairs(rows: DataFrame, over: bool = True, hot: int = 4096) -> DataFrame:
    """Pairs a < b in one predicted cluster and different gold ones (over), or the other way round.

    The pairs are the result, so their number is what it is. Clusters of up to ``hot`` rows are shuffled once and joined
    with themselves. A larger one is dealt to blocks of about ``hot`` rows, and each two blocks meet in a cell, so that its
    pairs come from many tasks. A label of over ``hot`` rows has blocks of its own, which do not meet each other: rows are
    copied only to cells that hold pairs, and the copies stay few beside these.
    """
    same, other = ("pred", "gold") if over else ("gold", "pred")
    rows = rows.where("key is not null and pred is not null and gold is not null").select("key", F.col(same).alias("s"), F.col(other).alias("o"))
    # Counted by a short hash: where two clusters share one, both may count as large, which is as right.
    h = F.hash("s").alias("h")
    large = F.broadcast(rows.groupBy(h).agg(F.count("*").alias("n")).where(F.col("n") > hot))  # at most one in ``hot`` rows
    # Both sides have the same columns, so that Spark makes one shuffle serve both.
    small = rows.join(large, F.hash("s") == F.col("h"), "left_anti")
    near = small.alias("x").join(small.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.o") != F.col("y.o"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))

    dealt = rows.join(large, F.hash("s") == F.col("h"))
    count = lambda n: F.ceil(n / hot).cast("int")
    # Large labels by their own values, as two of one hash would not meet; again at most one in ``hot`` rows.
    own = dealt.groupBy("h", "s", "o").agg(F.count("*").alias("m")).where(F.col("m") > hot).withColumn("parts", count(F.col("m")))
    taken = own.groupBy("h").agg(F.sum("parts").cast("int").alias("taken"), F.sum("m").alias("m"))
    first = (F.sum("parts").over(Window.partitionBy("h").orderBy("s", "o")) - F.col("parts")).cast("int").alias("first")
    dealt = dealt.join(F.broadcast(own.select("s", "o", "parts", first)), ["s", "o"], "left").join(F.broadcast(taken), "h", "left").na.fill(0, ["taken", "m"])
    mixed = count(F.col("n") - F.col("m"))
    place = lambda value, n: F.pmod(F.xxhash64(value), F.greatest(n, F.lit(1))).cast("int")
    block = F.coalesce(F.col("first") + place("key", F.col("parts")), F.col("taken") + place("o", mixed))
    dealt = dealt.select("key", "s", "o", "first", "parts", block.alias("block"), (F.col("taken") + mixed - 1).alias("last"))
    after, upto = F.coalesce(F.col("first") + F.col("parts"), "block"), F.coalesce(F.col("first") - 1, "block")
    x = dealt.where(after <= F.col("last")).select(F.col("key").alias("x"), "s", F.col("o").alias("ox"), F.col("block").alias("line"), F.explode(F.sequence(after, "last")).alias("column"))
    y = dealt.where(upto >= 0).select(F.col("key").alias("y"), "s", F.col("o").alias("oy"), F.col("block").alias("column"), F.explode(F.sequence(F.lit(0), upto)).alias("line"))
    far = x.join(y, ["s", "line", "column"]).where("ox <> oy and (x < y or line < column and x > y)")
    return near.unionByName(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def precision_recall(predicted: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """predicted and expected: distinct keys; expected has ``level`` core or optional (right, but not asked for)."""
    p = predicted.select(*key).distinct().withColumn("_p", F.lit(1))
    both = p.join(expected, key, "full")
    hit, core = F.col("_p").isNotNull() & F.col("level").isNotNull(), F.col("level") == "core"
    s = both.agg(F.sum(hit.cast("long")).alias("hits"), F.count("_p").alias("n"), F.sum((hit & core).cast("long")).alias("core_hits"), F.sum(core.cast("long")).alias("core"))
    return s.select(*report(ratio(F.col("hits"), F.col("n")), ratio(F.col("core_hits"), F.col("core"))), F.coalesce("hits", F.lit(0)).alias("hits"), F.col("n").alias("n_predicted"), F.coalesce("core", F.lit(0)).alias("n_core"))


def run_stats(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), least and greatest of the runs."""
    v = F.col(value)
    return runs.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def interval_merge(spans: DataFrame, key: str) -> DataFrame:
    """spans (key, start, stop): those that touch or overlap become one."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    ends = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.when(ends.isNull() | (F.col("start") > ends), 1).otherwise(0))
    grouped = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def keyword_positions(text: Column, form: str) -> Column:
    """0-based places of a form, without overlaps, case ignored: the pieces between the hits give them."""
    parts = F.split(F.lower(text), "\\Q" + form.lower() + "\\E", -1)
    n = len(form)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, step, lambda acc: acc["out"])


def kwic(texts: DataFrame, form: str, window: int = 40, key: str = "doc_id") -> DataFrame:
    """Merged windows around each hit: key, start, stop, passage."""
    # Windows merge within the row, so that neither repeated keys nor hot ones matter.
    width, zero = len(form), F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    spans = F.transform(keyword_positions(F.col("text"), form), lambda at: F.struct(F.greatest(at - window, F.lit(0)).alias("start"), F.least(at + width + window, F.length("text")).alias("stop")))

    def join(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"]), wider).otherwise(F.concat(acc, F.array(x)))

    hits = texts.where(F.contains(F.lower("text"), F.lit(form.lower()))).select(key, "text", F.explode(F.aggregate(spans, zero, join)).alias("x"))
    return hits.select(key, F.col("x.start").alias("start"), F.col("x.stop").alias("stop"), F.expr("substring(text, x.start + 1, x.stop - x.start)").alias("passage"))
