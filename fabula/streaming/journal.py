"""The journal as a stream: the same rules as in batch, kept up to date by Structured Streaming.

A late row is one whose story rank lies before rows already seen; its place in the order decides, not its arrival, so
no watermark drops it. State grows with the number of subjects and attributes, not with the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import final_state


def read_journal(spark, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of a journal as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def write_states(journal: DataFrame, subject: list[str], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Changed states of each micro-batch under ``path/batch_id=N``; the highest batch of a key is its state.

    A batch that is run again after a failure overwrites its own folder.
    """
    stream = final_state(journal, subject).writeStream.outputMode("update").option("checkpointLocation", checkpoint)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")

    stream = stream.foreachBatch(put)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def read_states(spark, subject: list[str], path: str) -> DataFrame:
    """The latest written state of each subject and attribute."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(path)
    return rows.groupBy(*subject, "attribute").agg(F.max_by("value", "batch_id").alias("value"))
