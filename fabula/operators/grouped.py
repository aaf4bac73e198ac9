"""Grouped Python over many small groups: one shuffle, Arrow batches, no exchange of rows for each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


#: Rows that pass to Python objects at once, and the rows and bytes of strings and files after which results go out: a
#: row may be a whole file.
SLICE, ROWS, BYTES = 256, 10_000, 8_000_000


def rows_of(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def batches_of(rows, schema):
    """Arrow batches of row tuples, bounded in rows and bytes; one at least."""
    import pyarrow as pa

    def batch(out):
        columns = zip(*out, strict=True) if out else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out, size, sized = [], 0, [i for i, f in enumerate(schema) if f.type in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary())]
    for row in rows:
        out.append(row)
        size += sum(len(row[i] or ()) for i in sized)
        if len(out) >= ROWS or size >= BYTES:
            yield batch(out)
            out, size = [], 0
    yield batch(out)


def map_rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function(row tuple) -> iterable of tuples`` for each row, where it lies."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from batches_of((out for row in rows_of(batches) for out in function(row)), out_schema)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable, schema: str) -> DataFrame:
    """``function(key values, list of row tuples) -> iterable of tuples`` for each group, rows in ``order``.

    Groups are whole within a partition and adjacent; one group at a time is in memory, so it must fit a Python worker:
    a graph is a book or a file, not a corpus. Values pass as Arrow does, with nulls and all digits of a long.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, out_schema = df.columns, to_arrow_schema(StructType.fromDDL(schema))
    at = [columns.index(k) for k in keys]

    def results(batches):
        last, rows = None, []
        for row in rows_of(batches):
            key = tuple(row[i] for i in at)
            if key != last and rows:
                yield from function(last, rows)
                rows = []
            last = key
            rows.append(row)
        if rows:
            yield from function(last, rows)

    def run(batches):
        yield from batches_of(results(batches), out_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
