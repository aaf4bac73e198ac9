"""Operator 10: near-duplicate documents by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text is a weighted set: a five-word shingle weighs its count times the mean inverse document frequency of its
words, idf = 1 + ln((1 + N) / (1 + df)). Document frequencies are counted over all documents in 2^16 hash buckets of
words, so what is gathered has a fixed size. ICWS draws ``BANDS * ROWS`` samples of each distinct text; texts that
share a band are compared by exact weighted Jaccard similarity, and the verified pairs' components are the classes.
With 16 bands of 4 samples a pair of similarity 0.8 shares a band with probability 0.9998.

Within a bucket of up to ``SMALL`` texts all are compared. In a larger one all are compared with one leader, which joins
a group of copies at one comparison a text. Buckets whose texts are not all in one class by then go the exact way:
their texts meet again by the rarest of their shingles, a fifth of their weight (two sets of similarity t share one of
the shingles that make up the rarest 1 - t of either), split by classes of total weight (similar sets differ by a factor
of 1 / t at most). At the first shingle that two texts share, what either weighs from there on bounds what they have in
common, so that a text with many edits of its own meets few others. Buckets of one class only are left out, small ones
compare all texts of different classes, large ones first with a leader and then, where classes still differ, all texts
of different classes that the bound allows. So a passage that many texts share costs no pairs, and no link between texts
that share a band is lost.

Defined results: a null text is an empty text. Equal texts are always one class, so all texts without words that are
equal are too; texts are told apart by a 64-bit hash (n different texts have some n^2 / 2^65 collisions). A text of 1 to
4 words is one shingle. Repeated rows each get a row. A null doc_id is a row like others; it is kept only if its class has
no other. An empty table gives an empty table. Other columns are ignored. ``keep`` marks the class's smallest doc_id (of
the rows that share that doc_id those with one of their texts).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, Words, bounded_batches, clean, components, forget, mix, shingles, slices, small_or_shuffled, tidy, written

BANDS, ROWS, THRESHOLD, SMALL = 16, 4, 0.8, 8
DF_BUCKETS, RARITY_BUCKETS = 1 << 16, 1 << 18
DRAWS = 1 << 13
_draws: dict[int, tuple[np.ndarray, ...]] = {}
CACHES = [_draws]


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each hash bucket, and the number of documents."""

    def count(batches):
        import pandas as pd

        total, rows = np.zeros(DF_BUCKETS, dtype=np.int64), 0
        for batch in batches:
            texts = clean(batch["text"])
            rows += len(texts)
            for i, j in slices(texts):
                w = Words(texts[i:j])
                own = w.text_of_word().astype(np.uint64) << np.uint64(16) | (w.hash & np.uint64(DF_BUCKETS - 1))
                own = np.unique(own)
                total += np.bincount((own & np.uint64(DF_BUCKETS - 1)).astype(np.int64), minlength=DF_BUCKETS)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(found, -1), "n": np.append(total[found], rows)})

    rows = docs.mapInPandas(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DF_BUCKETS, dtype=np.int64)
    for r in rows:
        if r["bucket"] >= 0:
            out[r["bucket"]] = r["n"]
    return out, sum(r["n"] for r in rows if r["bucket"] < 0)


def weighted_sets(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted), their weights, and offsets."""
    w = Words(texts)
    found, offset = shingles(w.hash, w.offset)
    value = np.concatenate([[0.0], np.cumsum(idf[(w.hash & np.uint64(DF_BUCKETS - 1)).astype(np.int64)])])
    n = np.diff(w.offset)
    per = np.diff(offset)
    first = np.arange(offset[-1]) + np.repeat(w.offset[:-1] - offset[:-1], per)
    length = np.repeat(np.minimum(n, SHINGLE), per)
    mean = (value[first + length] - value[first]) / np.maximum(length, 1)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), per)
    bits = np.uint64(max(1, int(len(texts)).bit_length()))
    key = (text << (np.uint64(64) - bits)) | (found >> bits)  # texts stay apart and in order
    key, at, count = np.unique(key, return_index=True, return_counts=True)
    starts = np.searchsorted(text[at], np.arange(len(texts) + 1, dtype=np.uint64))
    return found[at], mean[at] * count, starts


def draws(samples: int) -> tuple[np.ndarray, ...]:
    """1/r, r, beta + 1 and ln c of ICWS: three parts of a shingle's hash pick rows of fixed random tables, a column for each sample."""
    if samples not in _draws:
        rng = np.random.default_rng(20_240_601)
        r = rng.gamma(2.0, 1.0, (DRAWS, samples))
        _draws[samples] = tuple(np.ascontiguousarray(x, dtype=np.float32) for x in (1.0 / r, r, rng.random((DRAWS, samples)), np.log(rng.gamma(2.0, 1.0, (DRAWS, samples)))))
    return _draws[samples]


def signatures(found: np.ndarray, weight: np.ndarray, at: np.ndarray, samples: int) -> np.ndarray:
    """ICWS samples (shingle and level) as one hash each: a row for each set at[i]:at[i+1]; empty sets have zeros."""
    inverse, r, beta, lnc = draws(samples)
    column, block = np.arange(samples), 128  # blocks that stay in the processor's cache, in buffers that are used again
    t, b, a = (np.empty((block, samples), dtype=np.float32) for _ in range(3))
    who, level = np.zeros((len(at) - 1, samples), dtype=np.uint64), np.zeros((len(at) - 1, samples), dtype=np.int64)
    log_weight = np.log(weight).astype(np.float32)[:, None]
    # A shingle's r, beta and c come from rows of their own, so that no two shingles share all three.
    of_r, of_beta, of_c = ((found >> np.uint64(shift)).astype(np.int64) & (DRAWS - 1) for shift in (7, 20, 33))
    for doc in range(len(at) - 1):
        best = np.full(samples, np.inf, dtype=np.float32)
        for i in range(at[doc], at[doc + 1], block):
            end = min(i + block, at[doc + 1])
            n = end - i
            tt, bb, aa = t[:n], b[:n], a[:n]
            np.take(inverse, of_r[i:end], axis=0, out=tt, mode="clip")
            np.take(beta, of_beta[i:end], axis=0, out=bb, mode="clip")
            tt *= log_weight[i:end]
            tt += bb
            np.floor(tt, out=tt)
            bb -= tt
            bb -= 1
            np.take(r, of_r[i:end], axis=0, out=aa, mode="clip")
            bb *= aa
            np.take(lnc, of_c[i:end], axis=0, out=aa, mode="clip")
            aa += bb
            k = aa.argmin(axis=0)
            value = aa[k, column]
            better = np.flatnonzero(value < best)
            k = k[better]
            best[better], who[doc, better], level[doc, better] = value[better], found[i + k], tt[k, better]
    return mix(who + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(found: np.ndarray, weight: np.ndarray, at: np.ndarray, bands: int, rows: int) -> list[list[int]]:
    """The band keys of each set; none for an empty set."""
    s = signatures(found, weight, at, bands * rows).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2])
    for j in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + s[:, :, j])
    return [k if n else [] for k, n in zip(key.astype(np.int64).tolist(), np.diff(at), strict=True)]


def weight_classes(weight: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
    """Total weights on a scale on which sets of at least that similarity differ by one class at most; empty sets: 0."""
    total = np.concatenate([[0.0], np.cumsum(weight)])
    total = total[at[1:]] - total[at[:-1]]
    step = np.log((1.0 + 1e-5) / threshold)
    return np.floor(np.log(np.maximum(total, 1e-3)) / step).astype(np.int32)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two sorted weighted sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - low
    return float(low / whole) if whole else 0.0


def prefixes(found: np.ndarray, weight: np.ndarray, at: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """The rarest shingles of each set, as many as make what is left lighter than threshold times the set.

    Returns (set, shingle, weight of the set, its weight from this shingle on, in the order of rarity).
    """
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((found, rarity[(found & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64)], of))
    run = np.concatenate([[0.0], np.cumsum(weight[order])])
    whole = (run[at[1:]] - run[at[:-1]])[of]
    left = run[at[1:]][of] - run[:-1]
    inside = left >= threshold * whole * (1 - 1e-6)
    return of[inside], found[order][inside], whole[inside], left[inside]


def weighted_classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): the written rows (doc_id, tid), and (tid, class_id, class_size, lead) for each text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.withColumn("tid", text_id(F.col("text")))
    df, n = document_frequencies(docs)
    idf = 1.0 + np.log((1.0 + n) / (1.0 + df))

    def sign(batches):
        import pandas as pd

        for batch in batches:
            texts = clean(batch["text"])
            for i, j in slices(texts):
                found, weight, at = weighted_sets(texts[i:j], idf)
                yield pd.DataFrame({"doc_id": batch["doc_id"][i:j], "tid": batch["tid"][i:j], "weight": weight_classes(weight, at, threshold), "bands": band_keys(found, weight, at, bands, rows)})

    def compare(batches):
        import pandas as pd

        for batch in batches:
            a, b = clean(batch["text_a"]), clean(batch["text_b"])
            ok = np.zeros(len(a), dtype=bool)
            for i, j in slices(a, of=b):
                distinct = {t: k for k, t in enumerate(dict.fromkeys(a[i:j] + b[i:j]))}
                # A set alone keeps all bits of its hashes that a comparison needs, so both sides come from one call.
                found, weight, at = weighted_sets(list(distinct), idf)
                part = lambda t: (lambda k: _sorted(found[at[k] : at[k + 1]], weight[at[k] : at[k + 1]]))(distinct[t])  # noqa: B023, E731
                for k in range(i, j):
                    ok[k] = weighted_jaccard(part(a[k]), part(b[k])) >= threshold - 1e-9
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "ok": ok})

    def count(batches):
        import pandas as pd

        total = np.zeros(RARITY_BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = clean(batch["text"])
            for i, j in slices(texts):
                found, _, _ = weighted_sets(texts[i:j], idf)
                total += np.bincount((found & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64), minlength=RARITY_BUCKETS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    # Ids pass pandas as strings: a null would make numbers of them that lose digits.
    signed = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(tidy(sign), "doc_id string, tid long, weight int, bands array<long>")
    signed = written(spark, signed.withColumn("doc_id", F.col("doc_id").cast("long")))
    texts = written(spark, signed.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands")))

    def bodies(ids):
        """(tid, text) of the texts ``ids``, each once."""
        own = small_or_shuffled(written(spark, ids.join(texts, "tid").select(F.col("tid").alias("_tid"), "first")))
        return docs.join(own, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").groupBy("tid").agg(F.first("text").alias("text"))

    def verified(pairs):
        """The pairs (a, b) of ``pairs`` that are similar, written."""
        have = written(spark, bodies(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()))
        both = pairs.join(have.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").join(have.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
        yes = written(spark, both.select("a", "b", "text_a", "text_b").mapInPandas(tidy(compare), "a long, b long, ok boolean").where("ok").select("a", "b"))
        forget(spark, have)
        return yes

    share = threshold / (1 + threshold) * (1 - 1e-6)  # of the weight of both that similar sets have in common at least
    able = f"x.root <> y.root and least(x.left, y.left) >= {share} * (x.whole + y.whole)"

    def within(held):
        """Pairs of texts of different classes in a bucket of at most SMALL."""
        own = held.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("tid", "root", "whole", "left")).alias("t"))
        own = own.select(F.explode("t").alias("x"), "t").select("x", F.explode("t").alias("y")).where(f"x.tid < y.tid and {able}")
        return own.select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b"))

    def led(held):
        """Pairs of a larger bucket's leader with the others that are not known to be in its class."""
        own = held.where(F.col("n") > SMALL).select(F.struct("tid", "root", "whole", "left").alias("x"), F.col("top").alias("y")).where(able)
        return own.select(F.least("x.tid", "y.tid").alias("a"), F.greatest("x.tid", "y.tid").alias("b"))

    def labelled(rows, edges):
        """``rows`` with the class of their text as far as ``edges`` tell."""
        roots = components(spark, edges).select(F.col("node").alias("tid"), F.col("root").alias("_root"))
        return rows.join(roots, "tid", "left").withColumn("root", F.coalesce("_root", "tid")).drop("_root")

    spread = written(spark, texts.select(F.explode("bands").alias("key"), "tid"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = written(spark, spread.join(shared, "key"))
    # The text whose buckets are fullest is the nearest to a group's centre: as leader it leaves the fewest over.
    scores = held.groupBy("tid").agg(F.sum("n").alias("score"))
    no_bound = [F.lit(1.0).alias("whole"), F.lit(1.0).alias("left")]
    live = written(spark, held.join(scores, "tid").select("key", "tid", F.col("tid").alias("root"), "score", "n", *no_bound))
    forget(spark, spread, held)
    held = live.join(live.groupBy("key").agg(F.max(F.struct("score", "tid", "root", "whole", "left")).alias("top")), "key")
    pairs = written(spark, within(live).unionByName(led(held)).distinct())
    edges = verified(pairs)
    crowded = written(spark, labelled(live.where(F.col("n") > SMALL).select("key", "tid"), edges))
    forget(spark, live)
    mixed = crowded.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = written(spark, crowded.join(mixed, "key", "left_semi").select("tid", "root").distinct())
    forget(spark, crowded)
    if not rest.isEmpty():
        have = written(spark, bodies(rest.select("tid")))
        rarity = np.zeros(RARITY_BUCKETS, dtype=np.int32)  # a sketch of fixed size
        for r in have.mapInPandas(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").collect():
            rarity[r["bucket"]] = min(r["n"], 2**31 - 1)

        def rarest(batches):
            import pandas as pd

            for batch in batches:
                own = clean(batch["text"])
                for i, j in slices(own):
                    found, weight, at = weighted_sets(own[i:j], idf)
                    of, key, whole, left = prefixes(found, weight, at, rarity, threshold)
                    scale = weight_classes(weight, at, threshold)[of].astype(np.uint64)
                    for up in (0, 1):
                        yield pd.DataFrame({"key": mix(key + (scale + np.uint64(up)) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64), "tid": batch["tid"].to_numpy()[i + of], "whole": whole, "left": left})

        keys = written(spark, have.mapInPandas(tidy(rarest), "key long, tid long, whole double, left double"))
        forget(spark, have)
        # Keys that one text has alone need no class, and the bound drops rows that even the lightest partner does not help.
        shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("least")).where("n > 1")
        keys = written(spark, keys.join(shared.drop("n"), "key").where(f"left >= {share} * (whole + least)").join(rest, "tid").drop("least"))
        leaders = keys.groupBy("key").agg(F.max(F.struct(F.xxhash64("key", "tid").alias("h"), "tid", "root", "whole", "left")).alias("top"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        held = written(spark, keys.join(leaders.where("low <> high").drop("low", "high"), "key"))
        seen = written(spark, within(held).unionByName(led(held)).distinct().join(pairs, ["a", "b"], "left_anti"))
        edges = written(spark, edges.unionByName(verified(seen)))
        crowded = written(spark, labelled(held.where(F.col("n") > SMALL).select("key", "tid", "whole", "left"), edges))
        mixed = crowded.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        crowded = written(spark, crowded.join(mixed, "key", "left_semi"))
        if not crowded.isEmpty():
            last = crowded.alias("x").join(crowded.alias("y"), "key").where(f"x.tid < y.tid and {able}")
            last = last.select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b")).distinct()
            last = written(spark, last.join(pairs, ["a", "b"], "left_anti").join(seen, ["a", "b"], "left_anti"))
            edges = edges.unionByName(verified(last))
            forget(spark, last)
        forget(spark, keys, held, seen, crowded)
    named = written(spark, labelled(texts.select("tid", "first", "n"), edges))
    sizes = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "tid")).alias("top"), F.sum("n").alias("class_size"))
    classes = named.join(written(spark, sizes), "root").select("tid", F.col("top.first").alias("class_id"), "class_size", (F.col("tid") == F.col("top.tid")).alias("lead"))
    return signed.select("doc_id", "tid"), written(spark, classes)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size, keep. One row per row of ``docs``."""
    signed, classes = weighted_classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), threshold, bands, rows)
    keep = F.col("lead") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return signed.join(classes, "tid").select("doc_id", "class_id", "class_size", keep.alias("keep"))


def _sorted(found: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(found)
    return found[order], weight[order]


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, with all its columns; one row of it, if rows repeat. Null doc_ids count as ids."""
    signed, classes = weighted_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), THRESHOLD, BANDS, ROWS)
    kept = classes.where("lead").select(F.col("tid").alias("_tid"), F.col("class_id").alias("_first"))
    again = signed.join(kept, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("_first"))).groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")
    own = docs.withColumn("_own", text_id(F.col("text")))
    out = own.join(small_or_shuffled(written(spark, kept)), (F.col("_own") == F.col("_tid")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_first")), "left_semi")
    return (out if again.isEmpty() else out.dropDuplicates(["_own"])).select(docs.columns)
