"""Scripted cases of the reference's semantics, and the SQL twins on the smallest tables."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fabula import plans
from fabula.functions import text as fx
from fabula.operators import metrics, resolve, state, timeline

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_chunks(spark):
    df = spark.createDataFrame([("a" * 250,), (" \n\n ",), ("ab\n\ncd\n\nef",), (None,)], "t string")
    assert [r[0] for r in df.select(fx.split_chunks(F.col("t"), 100)).collect()] == [["a" * 100, "a" * 100, "a" * 50], [], ["ab\n\ncd\n\nef"], None]
    with pytest.raises(ValueError):
        fx.split_chunks(F.col("t"), 0)


def test_names(spark):
    df = spark.createDataFrame([(1, "L’Inspecteur  Marchal"), (2, "Saint‑Aubin‑Nord"), (3, "Mme Straße "), (4, None)], "i int, n string")
    k = fx.normalize_name(F.col("n"))
    assert [tuple(r) for r in df.orderBy("i").select(k, fx.strip_title(k), fx.normalize_exact("n")).collect()] == [("l'inspecteur marchal", "marchal", "l'inspecteur marchal"), ("saint-aubin-nord", None, "saint-aubin-nord"), ("mme strasse", "strasse", "mme strasse"), (None, None, None)]


def test_gaps(spark):
    cases = [(20.0, "années", 7300.0), (20.0, "ans", 7300.0), (3.0, "jours", 3.0), (2.0, "semaines", 14.0), (6.0, "mois", 180.0), (12.0, "heures", 0.5), (5.0, "lustres", None), (0.0, "jours", None)]
    df = spark.createDataFrame(cases, "v double, u string, want double")
    assert df.where(~fx.gap_to_days(F.col("v"), F.col("u")).eqNullSafe(F.col("want"))).count() == 0


def test_timeline_cases():
    m = [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert timeline.order_moments(m, [(1, "avant", 2, 7300.0), (2, "avant", 3, 1.0)])[1] == {1: 0.0, 2: 7300.0, 3: 7301.0}
    assert timeline.order_moments(m, [(1, "avant", 2, 10.0), (3, "simultané", 2, None)])[1] == {1: 0.0, 2: 10.0, 3: 10.0}
    order, _, notes = timeline.order_moments(m[:2], [(1, "avant", 2, None), (2, "avant", 1, None)])
    assert order == {1: 0, 2: 1} and any(n.startswith("cycle") for n in notes)
    _, days, notes = timeline.order_moments(m, [(1, "avant", 3, 10.0), (1, "avant", 2, 2.0), (2, "avant", 3, 20.0)])
    assert days == {1: 0.0, 2: 2.0, 3: 10.0} and any(n.startswith("conflict") for n in notes)
    assert timeline.order_moments(m, [(2, "avant", 1, None)])[0] == {2: 0, 1: 1, 3: 2}
    assert timeline.order_moments([], []) == ({}, {}, [])


def test_state_and_history(spark):
    j = spark.createDataFrame([(1, "a", "âge", "8", 0), (2, "a", "âge", "18", 3), (3, "a", "ville", "D", None), (4, "a", "âge", "18", 5), (5, "a", "âge", "9", 0)], "assertion_id long, entity string, attribute string, value string, rank int")
    assert rows(state.final_state(j, ["entity"])) == [("a", "ville", "D"), ("a", "âge", "18")]
    assert rows(state.final_state(j, ["entity"], at=2)) == [("a", "ville", "D"), ("a", "âge", "8")]
    assert [r["value"] for r in state.history(j, ["entity"]).orderBy("position").collect()] == ["8", "9", "18"]
    assert rows(state.runs(spark.createDataFrame([("a", 0), ("a", 2), ("a", 3)], "entity string, rank int"))) == [("a", 0, 0), ("a", 2, 3)]


def test_titles_fold(spark):
    fold = lambda *n: resolve.fold_entities(spark.createDataFrame([(1, i, x, "") for i, x in enumerate(n)], "graph_id int, seq int, name string, type string")).count()
    assert fold("Marchal", "inspecteur Marchal", "l'inspecteur Marchal") == 1
    assert fold("M. Duval", "Mme Duval") == 2
    assert (fold("M. X", "X", "Mme X"), fold("Mme X", "M. X", "X")) == (2, 3)


def test_merge_group_types(spark):
    m = spark.createDataFrame([(1, 0, "b", i, n, t) for i, (n, t) in enumerate([("a", "personnage"), ("b", "inconnu"), ("c", "lieu")])], "graph_id int, group_no int, canonical string, member_pos int, member string, type string")
    assert rows(resolve.merge_groups(m)) == [(1, "a", "b"), (1, "b", "b")]


def test_cluster_scores(spark):
    df = lambda p, g: spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(p, g, strict=True))], "key int, pred string, gold string")
    assert rows(metrics.bcubed(df("1111", "aabb")))[0][:2] == (0.5, 1.0) and metrics.confusion_pairs(df("1111", "aabb")).count() == 4
    assert rows(metrics.bcubed(df("1234", "aaaa")))[0][:2] == (1.0, 0.25) and metrics.confusion_pairs(df("1234", "aaaa"), over=False).count() == 6
    assert rows(metrics.lea(df("111", "aab")))[0][:2] == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))


def shuffled(spark, df):
    """Rows that a count of df writes to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    total = lambda: (lambda x: sum(x.apply(i).shuffleWriteRecords() for i in range(x.size())))(stages())
    before = total()
    df.count()
    return total() - before


def test_confusion_pairs_of_small_and_large_clusters(spark):
    rng = random.Random(5)
    pred = [rng.choice("abb" + "ccccccccc" * 5) if i % 3 else f"s{i // 9}" for i in range(900)]
    found = [(i, p, rng.choice("xyz") if p != "b" else "x") for i, p in enumerate(pred)] + [(900, None, "x"), (901, "a", None), (0, "c", "other")]
    want = sorted((a, b) for a, p, g in found for b, q, h in found if p == q and g != h and a < b and None not in (p, g, h))
    df = spark.createDataFrame(found, "key long, pred string, gold string")
    turned = df.select("key", F.col("gold").alias("pred"), F.col("pred").alias("gold"))
    for hot in (1, 8, 100, 4096):
        assert sorted(map(tuple, metrics.confusion_pairs(df, hot=hot).collect())) == want
        assert sorted(map(tuple, metrics.confusion_pairs(turned, over=False, hot=hot).collect())) == want


def test_pairs_of_small_clusters_are_not_copied(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), F.expr("cast(id div 4 as string)").alias("pred"), F.expr("cast(id % 4 as string)").alias("gold"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffled(spark, metrics.confusion_pairs(df)) < 3 * 4000  # it was 32 for each row
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_spans_that_repeat_stay_in_their_island(spark):
    rng = random.Random(7)
    spans = [(k, s, s + rng.randrange(3)) for k in range(20) for s in (rng.randrange(120) for _ in range(60)) for _ in range(rng.randrange(1, 5))]
    want = []
    for k in range(20):
        own = []
        for _, start, stop in sorted(x for x in spans if x[0] == k):
            if own and start <= own[-1][2]:
                own[-1] = (k, own[-1][1], max(stop, own[-1][2]))
            else:
                own.append((k, start, stop))
        want += own
    df = spark.createDataFrame(spans, "key long, start long, stop long").repartition(7)
    assert sorted(map(tuple, metrics.interval_merge(df, "key").select("key", "start", "stop").collect())) == sorted(want)


def test_pairs_of_a_large_cluster_with_one_large_label(spark):
    found = [(i, "c", "main" if i % 400 else f"odd{i}") for i in range(4000)]
    df = spark.createDataFrame(found, "key long, gold string, pred string")
    pairs = metrics.confusion_pairs(df, over=False, hot=100)
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j) for i in range(4000) for j in range(i + 1, 4000) if not (i % 400 and j % 400))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffled(spark, pairs) < 3 * 4000  # it was 80 for each row
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merged_pairs_with_nulls_and_repeated_keys(spark, tmp_path):
    """Against the SQL: flags, orders and line numbers may be null, keys may repeat, one order is large."""
    rng = random.Random(7)
    some = lambda x: None if rng.random() < 0.1 else x
    lines = [(some(1 if i < 300 else rng.randrange(2, 60)), some(rng.randrange(1, 400)), some(rng.choice("ANR"))) for i in range(700)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("q_under_merged", "q_over_merged"):
        want = sorted(con.execute(plans.oracle_sql()[name]).fetchall())
        assert want and rows(plans.queries()[name](spark, str(tmp_path))) == sorted(want, key=repr)


def test_keyword_in_context(spark):
    df = spark.createDataFrame([(1, "aaaa b AA"), (2, "none")], "doc_id int, text string")
    assert rows(metrics.kwic(df, "aa", 1)) == [(1, 0, 5, "aaaa "), (1, 6, 9, " AA")]


@pytest.mark.parametrize("name", ["q_state_final", "q_states", "q_timeline_days", "q_resolve_mentions", "q_chunk_stats", "q_merge_vote", "q_lea", "q_transitions"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations pages".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert rows(df.select(*columns)) == sorted((tuple(r) for r in con.sql(f"select {', '.join(columns)} from ({plans.oracle_sql()[name]})").fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
