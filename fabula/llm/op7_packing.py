"""Operator 7: packing by cutting-stock column generation.

1. One pass encodes each document, adds id 0 and cuts it into pieces: full sequences and a shorter rest. The pieces'
   ids are written.
2. The histogram of piece lengths, in units of ``UNIT`` tokens rounded up (at most ``capacity / UNIT`` numbers, the
   only thing the driver gathers) is the demand of a cutting-stock linear program. A revised simplex over patterns
   is fed by an unbounded-knapsack dynamic program that prices columns, until no pattern is better by more than
   ``gap``. Rounding up costs half a unit a piece on average, well under one per cent.
   Where patterns would leave more than ``WASTE`` of the room empty (a length that many documents share and that fits
   no other), as many of their longest pieces are cut in two as fill what is left, and the program is solved again.
   Whole parts of a piece length are cut, chosen by hash, so that the histogram stays exact without a look at pieces.
3. Patterns are rounded down; what they leave (a bounded number of pieces, as there are at most as many patterns
   as lengths) is packed by best fit, decreasing, as further patterns used once.
4. Pieces are ranked within their length and each takes the slot of its rank. Ranks come from counts by (length,
   bucket of hashed ids), so that a length that many documents share is dealt over many tasks.

``pack`` also returns each piece's ids, which queries that do not ask for them never read again.

Defined results: a null text is an empty text and gives one piece of id 0; repeated rows are packed each for
itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import bounded_batches, clean, slices, tidy, written

CAPACITY, UNIT = 1024, 8
#: Share of empty room that is left to itself; parts of a length that can be cut; turns of cutting.
WASTE, PARTS, TURNS = 0.01, 256, 4
_encoders: dict[str, bpe.ByteEncoder] = {}
CACHES = [_encoders]
PIECES = "doc_id string, start long, length int, doc_tokens long, ids binary"


def encoder(path: str) -> bpe.ByteEncoder:
    if path not in _encoders:
        _encoders[path] = bpe.ByteEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        coder = encoder(path)
        for batch in batches:
            keys, texts = batch["doc_id"].tolist(), clean(batch["text"])
            for i, j in slices(texts):
                ids, offset = coder.encode(texts[i:j])
                ids = ids.astype("<u4")
                rows = []
                for k in range(j - i):
                    own = ids[offset[k] : offset[k + 1]].tobytes() + b"\0\0\0\0"
                    n = len(own) // 4
                    for start in range(0, n, capacity):
                        part = own[4 * start : 4 * (start + capacity)]
                        rows.append((keys[i + k], start, len(part) // 4, n, part))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])

    # Ids pass pandas as strings: a null would make numbers of them that lose digits.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), PIECES)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming; value[l] is the price of a piece of length l (0: none)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        found = best[:c] + value[c:0:-1]  # a piece of length c, c-1, ... 1 goes in last
        k = int(found.argmax())
        if found[k] > best[c - 1] + 1e-12:
            best[c], took[c] = found[k], c - k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(capacity + 1, dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row exchanges. The matrix is small, and threads of a linear algebra library can hang beside Spark's."""
    n = len(matrix)
    both = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        at = k + int(np.abs(both[k:, k]).argmax())
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float, rounds: int) -> list[tuple[np.ndarray, float]]:
    """(pattern over ``lengths``, times as a fraction) of a basis that meets the demand within ``gap`` of the bound.

    Prices are smoothed towards the best dual solution so far, at first the share of a sequence that a length fills;
    without that, the prices of a degenerate basis swing and the patterns found are of little use.
    """
    m = len(lengths)
    fit = capacity // lengths
    basis = np.diag(fit).astype(np.int64)  # a column for each pattern
    inverse, x = np.diag(1.0 / fit), demand / fit
    centre = lengths / capacity
    bound = float(centre @ demand)
    dense = np.zeros(capacity + 1)
    smooth = 0.95
    for turn in range(rounds):
        if x.sum() <= (1 + gap) * bound:
            break
        if turn and turn % 300 == 0:
            inverse = inverted(basis)  # against rounding errors
            x = np.maximum(inverse @ demand, 0)
        price = inverse.sum(axis=0)  # a sequence costs 1
        while True:
            used = smooth * centre + (1 - smooth) * price
            dense[lengths] = np.maximum(used, 0)
            worth, pattern = best_pattern(dense, capacity)
            if (reached := float(np.maximum(used, 0) @ demand) / max(worth, 1.0)) > bound:
                bound, centre = reached, np.maximum(used, 0) / max(worth, 1.0)
            column = pattern[lengths]
            if price @ column > 1 + 1e-7 or smooth < 0.01:
                break
            smooth *= 0.6  # no better pattern by these prices: move towards the true ones
        if price @ column <= 1 + 1e-7:
            break
        smooth = min(0.95, smooth * 1.1 + 0.02)
        move = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(x, move, out=ratio, where=move > 1e-9)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out] = column
    return [(basis[:, k], float(x[k])) for k in range(m)]


def plan(histogram: dict[int, int], capacity: int, gap: float = 0.002, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Whole patterns {length: pieces} and how often each is used; together they hold exactly the histogram."""
    left = dict(histogram)
    out: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        out.append(({capacity: 1}, left.pop(capacity)))
    if left:
        lengths = np.array(sorted(left))
        demand = np.array([left[k] for k in lengths], dtype=float)
        for column, times in column_generation(lengths, demand, capacity, gap, rounds):
            own = {int(n): int(k) for n, k in zip(lengths, column, strict=True) if k}
            times = min([int(times + 1e-6), *(left[n] // k for n, k in own.items())])
            if times > 0:
                out.append((own, times))
                for n, k in own.items():
                    left[n] -= k * times
    # Best fit, decreasing: for each room the open sequences that have it.
    room: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            size = next((r for r in range(n, capacity) if room[r]), capacity)
            own = room[size].pop() if size < capacity else {}
            own[n] = own.get(n, 0) + 1
            room[size - n].append(own)
    same: dict[tuple, int] = {}
    for own in (x for r in room for x in r):
        key = tuple(sorted(own.items(), reverse=True))
        same[key] = same.get(key, 0) + 1
    return out + [(dict(k), n) for k, n in same.items()]


def cuts(counts: dict[tuple[int, int], int], capacity: int, waste: float = WASTE) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """(length, from part, to part, first cut) of the pieces to cut in two, and the histogram after that.

    ``counts``: pieces by (length, part).
    """
    histogram: dict[int, int] = {}
    for (n, _), k in counts.items():
        histogram[n] = histogram.get(n, 0) + k
    out: list[tuple[int, int, int, int]] = []
    done: dict[int, int] = {}  # parts of a length that are cut already
    for _ in range(TURNS):
        volume = sum(n * k for n, k in histogram.items())
        patterns = [(own, times, capacity - sum(n * k for n, k in own.items())) for own, times in plan(histogram, capacity)]
        if sum(times for _, times, _ in patterns) * capacity <= (1 + waste) * volume + capacity:
            break
        before = len(out)
        for own, times, room in sorted(patterns, key=lambda x: -x[1] * x[2]):
            if not room or times * room * TURNS <= waste * volume:
                continue
            of = max((n for n in own if n > room), default=0) or max((n for n in histogram if n > room and n < capacity), default=0)
            k = own.get(of, 0)
            wanted, got, first = times * k / (k + 1) if k else times, 0, done.get(of, 0)
            part = first
            while of and part < PARTS and got + counts.get((of, part), 0) <= wanted:
                got += counts.get((of, part), 0)
                part += 1
            if got:
                out.append((of, first, part, room))
                done[of] = part
                for n, change in ((of, -got), (room, got), (of - room, got)):
                    histogram[n] = histogram.get(n, 0) + change
        histogram = {n: k for n, k in histogram.items() if k}
        if len(out) == before:
            break
    return out, histogram


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence) for each pattern and length."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for own, times in patterns:
        for n, k in sorted(own.items(), reverse=True):
            first = taken.get(n, 0)
            taken[n] = first + k * times
            out.append((n, first, taken[n], sequence, k))
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits each)."""
    if capacity % UNIT:
        raise ValueError(f"capacity must be a multiple of {UNIT}")
    spark = docs.sparkSession
    bounded_batches(spark)
    units = F.ceil(F.col("length") / UNIT).cast("int")
    cut = written(spark, pieces(docs, path or default_path(), capacity, id_col, text_col))
    cut = cut.withColumn("units", units).withColumn("part", F.pmod(F.xxhash64("start", "doc_id"), F.lit(PARTS)).cast("int"))
    # At most capacity / UNIT * PARTS rows, whatever the input.
    counts = {(r["units"], r["part"]): r["n"] for r in cut.groupBy("units", "part").agg(F.count("*").alias("n")).collect()}
    split, histogram = cuts(counts, capacity // UNIT)
    if split:
        spec = spark.createDataFrame(split, "of int, low int, high int, room int")  # a few rows a turn and length
        cut = cut.join(F.broadcast(spec), (F.col("units") == F.col("of")) & (F.col("part") >= F.col("low")) & (F.col("part") < F.col("high")), "left")
        first = F.col("room") * UNIT
        piece = lambda at, n: F.struct((F.col("start") + at).alias("start"), n.cast("int").alias("length"), F.substring("ids", at * 4 + 1, n * 4).alias("ids"))
        both = F.when(F.col("room").isNull(), F.array(piece(F.lit(0), F.col("length")))).otherwise(F.array(piece(F.lit(0), first), piece(first, F.col("length") - first)))
        cut = cut.select("doc_id", "doc_tokens", F.explode(both).alias("p")).select("doc_id", "p.start", "p.length", "doc_tokens", "p.ids").withColumn("units", units)
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    rows = slots(plan(histogram, capacity // UNIT))
    buckets = max(64, sum(histogram.values()) // 200_000)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("units", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("units", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("own", F.row_number().over(inside)).join(counts, ["units", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # Bounded: a row for each length in each pattern, of at most capacity / UNIT patterns and what rounding left.
    where = spark.createDataFrame(rows, "of int, first long, past long, sequence long, pieces long")
    held = ranked.join(F.broadcast(where), (F.col("units") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    held = held.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("pieces")).cast("long"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length").cast("long")).over(earlier), F.lit(0))
    return held.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", offset.cast("long").alias("offset"), "ids")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
