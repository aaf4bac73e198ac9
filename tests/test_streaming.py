"""The streamed journal against the batch rules."""

from fabula.operators.state import final_state
from fabula.streaming.journal import read_journal, read_states, write_states

SCHEMA = "assertion_id long, entity string, attribute string, value string, rank int"


def test_states_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = [
        [(1, "Ann", "age", "8", None), (2, "Ann", "age", "18", 5)],
        [(3, "Ann", "age", "12", 2), (4, "Bob", "", "x", 1), (5, "Bob", "job", None, 3)],  # late, no attribute, null value
        [(6, "Ann", "age", "19", 5), (7, "Bob", "job", "smith", 4)],  # a tie stays with the earliest
    ]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = write_states(read_journal(spark, source, SCHEMA), ["entity"], out, check)
        assert query.awaitTermination(60)
        assert query.exception() is None
    got = {tuple(r) for r in read_states(spark, ["entity"], out).collect()}
    assert got == {tuple(r) for r in final_state(spark.read.parquet(source), ["entity"]).collect()}
    assert got == {("Ann", "age", "18"), ("Bob", "job", "smith")}
