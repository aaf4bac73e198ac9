"""Operator 8: passages of over 50 words that documents share, by exact seeds that are extended over edits.

Each text of over 50 words gives the hashes of some of its runs of ``SEED`` words, those that are the smallest of some
``SPREAD`` runs in a row (winnowing): two texts with ``SEED + SPREAD - 1`` = 25 words in a row in common share a seed.
Passages of over 50 words whose five-word shingles, counted by place, have a Jaccard similarity of 0.8 always have such
a run (one edit costs up to 5 shingles, so there is at most one in some 45 words). Documents that share a seed, or two
seeds in a row, meet the smallest document that holds the same. In each such pair of texts all common runs of 25
words are extended word by word on both sides, over edits of up to ``GAP`` words; the longest stretches of the result
that pass the similarity and the length are passages, and the later document loses them whole.

Not exact: a passage is missed if the smallest holder of each of its seeds, and of each two seeds in a row, holds the
seeds but not the passage.

Defined results: a null text is an empty text and stays as it is (null). Documents without a removal keep their text to
the byte. Repeats within one document stay. Rows that share a doc_id count as one document. An empty table gives an
empty table. Other columns stay as they are in ``remove``; clashing names do not matter, as ``documents`` is joined by
doc_id and a hash of the text under names of our own. ``classes`` are the seeds of a passage that both documents hold.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, Words, bounded_batches, clean, forget, mix, shingles, slices, small_or_shuffled, tidy, written

WINDOW, MIN_WORDS, THRESHOLD = 24, 51, 0.8
SEED, SPREAD, GAP = 12, 14, 16
RUN = SEED + SPREAD - 1
SPAN = "array<struct<start:bigint,end:bigint,words:bigint,classes:array<bigint>>>"


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def picked(value: np.ndarray, text: np.ndarray, texts: int, width: int) -> np.ndarray:
    """Which values are the smallest of some ``width`` in a row in their text; the greatest number is never picked."""
    top = np.uint64(2**64 - 1)
    place = np.arange(len(value)) + (text + 1) * width  # room between texts, so that no window sees two
    padded = np.full(len(value) + (texts + 1) * width, top)
    padded[place] = value
    low = rolling_min(padded, width)
    widest = np.iinfo(np.uint64).max - rolling_min(np.iinfo(np.uint64).max - low, width)  # greatest minimum of the windows over a word
    return (widest[place - width + 1] == value) & (value != top)


def segments(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each paragraph and the text that it is in; a text's first word always begins one."""
    n = np.diff(w.offset)
    texts = len(n)
    if not len(w.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = w.text_of_word()
    top = np.uint64(2**64 - 1)
    following = np.append(w.hash[1:], np.uint64(0))
    value = mix(w.hash * np.uint64(0x9E3779B97F4A7C15) + following) >> np.uint64(1)
    value[w.offset[1:][n > 0] - 1] = top  # what follows a last word is another text
    anchor = picked(value, text, texts, WINDOW)
    anchor[w.offset[:-1][n > 0]] = True
    first = np.flatnonzero(anchor)
    return first, text[first]


def paragraphs(texts: list[str], bands: int):
    """(text, index in it, byte start, byte end, words, hash, band keys) arrays of all paragraphs."""
    w = Words(texts, ascii_only=True)
    first, text = segments(w)
    if not len(first):
        return None
    last = np.append(first[1:], len(w.hash))
    found, offset = shingles(w.hash, np.append(first, len(w.hash)))
    size = np.diff(offset)
    fp = np.add.reduceat(mix(found + np.uint64(1)), offset[:-1]) + (last - first).astype(np.uint64)
    keys = []
    for b in range(bands):
        salt = np.uint64((0xA24BAED4963EE407 * (b + 1)) & (2**64 - 1))
        keys.append(mix(np.minimum.reduceat(mix(found ^ salt), offset[:-1]) + np.uint64(b)).astype(np.int64))
    assert (size > 0).all()
    begin = w.begin[text]
    start = np.where(np.append(-1, text[:-1]) != text, 0, w.start[first] - begin)  # what stands before the first word is its paragraph's
    end = np.append(start[1:], 0)
    ends_text = np.append(text[1:], -1) != text
    end[ends_text] = (w.begin[text + 1] - 1 - begin)[ends_text]
    index = np.arange(len(first)) - np.searchsorted(text, text)
    return text, index, start, end, last - first, mix(fp).astype(np.int64), np.stack(keys, axis=1), found, offset


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) - 2**31


def seeds(w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of SEED words, offsets by text, and which of them are seeds; texts under ``min_words`` have none."""
    found, offset = shingles(w.hash, w.offset, SEED)
    if not len(found):
        return found, offset, np.zeros(0, dtype=bool)
    text = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    return found, offset, picked(found >> np.uint64(1), text, len(offset) - 1, SPREAD) & (np.diff(w.offset) >= min_words)[text]


def common_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words of two word arrays are equal."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        end = min(n, at + step)
        other = a[at:end] != b[at:end]
        if other.any():
            return at + int(other.argmax())
        at, step = end, step * 2
    return n


_I, _J = np.indices((GAP + 1, GAP + 1))
_EDIT = _I + _J
_NEED = np.where((_I == 1) & (_J == 1), 1, np.where(np.maximum(_I, _J) <= 2, 2, 4))


def resume(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """Words of a and b to pass over until both go on alike; the larger the edit, the longer the run that it takes."""
    if not len(a) or not len(b):
        return None
    eq = a[: GAP + 5, None] == b[None, : GAP + 5]
    if not eq.any():
        return None
    run = eq.astype(np.int64)
    for _ in range(4):  # lengths of runs, up to 5
        run[:-1, :-1] = eq[:-1, :-1] * np.minimum(1 + run[1:, 1:], 5)
    run = run[: GAP + 1, : GAP + 1]
    rows, columns = run.shape
    worth = np.where(run >= _NEED[:rows, :columns], 4 * run - _EDIT[:rows, :columns], -1000)
    i, j = divmod(int(worth.argmax()), columns)
    return (i, j) if worth[i, j] > -1000 else None


def passages(d: np.ndarray, h: np.ndarray, kd: np.ndarray, kh: np.ndarray, threshold: float, min_words: int) -> list[tuple[int, int, int, int]]:
    """(first, end in d, first, end in h) of the passages of word arrays d and h, whose runs of SEED words hash to kd and kh.

    Only common runs of RUN words are extended, as every passage that passes holds one.

    A similarity of t means (1 + t) * common >= t * (shingles of both), a sum over equal runs and the edits between.
    """
    gain = lambda n: (1 + threshold) * max(0, n - SHINGLE + 1) - 2 * threshold * n
    slack = 2 * threshold * (SHINGLE - 1) + 1e-9
    order = np.argsort(kh, kind="stable")
    known = kh[order]
    low, high = np.searchsorted(known, kd), np.searchsorted(known, kd, "right")
    out: list[tuple[int, int, int, int]] = []
    tried: dict[int, int] = {}  # by diagonal: where the last run that was looked at ends in d
    covered = np.zeros(len(d), dtype=bool)

    def side(a, b, most):
        """Runs that follow, as (words passed over in a, in b, equal words)."""
        steps, p, q, now, best = [], 0, 0, 0.0, 0.0
        while now > best - most and (edit := resume(a[p:], b[q:])):
            x, y = edit
            n = common_run(a[p + x :], b[q + y :])
            steps.append((x, y, n))
            p, q = p + x + n, q + y + n
            now += gain(n) - threshold * (x + y)
            best = max(best, now)
        return steps

    def best_parts(chain):
        """Longest stretches of runs (i, j, n) that pass, and those before and after them."""
        if not chain or min(chain[-1][0] + chain[-1][2] - chain[0][0], chain[-1][1] + chain[-1][2] - chain[0][1]) < min_words:
            return
        total = np.zeros(len(chain) + 1)
        for k, (i, j, n) in enumerate(chain):
            edit = (i - chain[k - 1][0] - chain[k - 1][2] + j - chain[k - 1][1] - chain[k - 1][2]) if k else 0
            total[k + 1] = total[k] + gain(n) - threshold * edit
        start = total[:-1].copy()
        for k in range(1, len(chain)):  # a stretch does not pay for the edit before it
            start[k] = total[k + 1] - gain(chain[k][2])
        best = None
        for k in range(len(chain)):
            ok = np.flatnonzero(total[k + 1 :] - start[k] + slack >= 0)
            if len(ok):
                e = k + int(ok[-1])
                words = min(chain[e][0] + chain[e][2] - chain[k][0], chain[e][1] + chain[e][2] - chain[k][1])
                if words >= min_words and (best is None or words > best[0]):
                    best = words, k, e
        if best is None:
            return
        _, s, e = best
        size = lambda s, e: min(chain[e][0] + chain[e][2] - chain[s][0], chain[e][1] + chain[e][2] - chain[s][1])
        # One or two words that are equal by chance do not make a passage longer than it must be.
        passes = lambda s, e: size(s, e) >= min_words and total[e + 1] - start[s] + slack >= 0
        while s < e and chain[e][2] < 3 and passes(s, e - 1):
            e -= 1
        while s < e and chain[s][2] < 3 and passes(s + 1, e):
            s += 1
        out.append((chain[s][0], chain[e][0] + chain[e][2], chain[s][1], chain[e][1] + chain[e][2]))
        covered[chain[s][0] : chain[e][0] + chain[e][2]] = True
        best_parts(chain[:s])
        best_parts(chain[e + 1 :])

    # A common run of RUN words is SPREAD runs of SEED words, one from each word on.
    place = np.flatnonzero(high > low)
    part = np.cumsum(np.diff(place, prepend=-1) != 1)
    for i in place[(np.bincount(part) >= SPREAD)[part]].tolist():
        if covered[i] and covered[i + SEED - 1]:
            continue
        for j in order[low[i] : high[i]].tolist():
            if i < tried.get(i - j, 0):
                continue
            before = common_run(d[:i][::-1], h[:j][::-1])
            n = before + common_run(d[i:], h[j:])
            i0, j0 = i - before, j - before
            if n < RUN:
                tried[i - j] = i0 + n
                continue
            most = 150 * threshold + n
            left = side(d[:i0][::-1], h[:j0][::-1], most)
            right = side(d[i0 + n :], h[j0 + n :], most + sum(x[2] for x in left))
            chain, p, q = [(i0, j0, n)], i0, j0
            for x, y, m in left:
                p, q = p - x - m, q - y - m
                chain.insert(0, (p, q, m))
            p, q = i0 + n, j0 + n
            for x, y, m in right:
                chain.append((p + x, q + y, m))
                p, q = p + x + m, q + y + m
            for a, b, m in chain:
                tried[a - b] = max(tried.get(a - b, 0), a + m)
            best_parts(chain)
            if covered[i] and covered[i + SEED - 1]:
                break
    return out


def repeated(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to remove: doc_id, crc (of the text), spans array<struct<start, end (bytes), words, classes>>. A written table."""
    if threshold < THRESHOLD or min_words < MIN_WORDS:
        raise ValueError(f"seeds find passages of {MIN_WORDS} words or more at a similarity of {THRESHOLD} or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def cut(batches):
        import pandas as pd

        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), clean(batch["text"])
            for i, j in slices(texts):
                found, offset, mark = seeds(Words(texts[i:j], ascii_only=True), min_words)
                at = np.flatnonzero(mark)
                text = np.searchsorted(offset, at, "right") - 1
                fp = found[at].astype(np.int64)
                after = np.append(np.where(text[1:] == text[:-1], fp[1:], 0), np.zeros(min(1, len(fp)), dtype=np.int64))
                yield pd.DataFrame({"doc_id": ids[i:j][text], "fp": fp, "after": after})

    def compare(batches):
        import pandas as pd

        for batch in batches:
            ids, texts, homes = batch["doc_id"].tolist(), clean(batch["text"]), clean(batch["home_text"])
            for i, j in slices(texts, of=homes):
                distinct = {t: k for k, t in enumerate(dict.fromkeys(texts[i:j] + homes[i:j]))}
                w = Words(list(distinct), ascii_only=True)
                found, offset, mark = seeds(w, min_words)
                rows = []
                for k in range(i, j):
                    x, y = distinct[texts[k]], distinct[homes[k]]
                    n, m = w.offset[x + 1] - w.offset[x], w.offset[y + 1] - w.offset[y]
                    if min(n, m) < min_words:
                        continue
                    kd, kh = found[offset[x] : offset[x + 1]], found[offset[y] : offset[y + 1]]
                    first, begin = w.start[w.offset[x] : w.offset[x + 1]] - w.begin[x], w.begin[x + 1] - 1 - w.begin[x]
                    for a, b, c, e in passages(w.hash[w.offset[x] : w.offset[x + 1]], w.hash[w.offset[y] : w.offset[y + 1]], kd, kh, threshold, min_words):
                        own = kd[a : b - SEED + 1][mark[offset[x] + a : offset[x] + b - SEED + 1]]
                        classes = np.intersect1d(own, kh[c : e - SEED + 1]).astype(np.int64)
                        rows.append((ids[k], crc(texts[k]), a, b, int(first[a]) if a else 0, int(first[b]) if b < n else int(begin), classes.tolist()))
                yield pd.DataFrame(rows, columns=["doc_id", "crc", "a", "b", "start", "end", "classes"])

    def merge(batches):
        import pandas as pd

        for batch in batches:
            lists = []
            for found in batch["u"]:
                spans = []  # [first word, end word, start, end, classes]
                for x in sorted(found, key=lambda x: (x["a"], x["b"])):
                    if spans and x["a"] <= spans[-1][1]:
                        last = spans[-1]
                        last[1], last[3] = max(last[1], x["b"]), max(last[3], x["end"])
                        last[4].update(dict.fromkeys(x["classes"]))
                    else:
                        spans.append([x["a"], x["b"], x["start"], x["end"], dict.fromkeys(x["classes"])])
                lists.append([{"start": s[2], "end": s[3], "words": s[1] - s[0], "classes": list(s[4])} for s in spans])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "crc": batch["crc"], "spans": lists})

    units = written(spark, docs.mapInPandas(tidy(cut), "doc_id long, fp long, after long"))
    homes = lambda rows, key: rows.groupBy(key).agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("far")).where("home <> far").drop("far")
    hits = written(spark, units.join(homes(units, "fp"), "fp").select("doc_id", "home", F.xxhash64("fp", "after").alias("both")))
    forget(spark, units)
    second = hits.select("doc_id", "both").join(homes(hits, "both"), "both").select("doc_id", "home")
    pairs = written(spark, hits.select("doc_id", "home").unionByName(second).where("doc_id <> home").distinct())
    forget(spark, hits)
    later, home = written(spark, pairs.select("doc_id").distinct()), written(spark, pairs.select(F.col("home").alias("doc_id")).distinct())
    # Different texts of one doc_id, once each; partitioned by doc_id, as the joins need.
    held = lambda ids: docs.join(small_or_shuffled(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("t")).select("doc_id", F.explode("t").alias("text"))
    # The text of a document that many others meet is joined to short rows.
    led = pairs.join(held(home).select(F.col("doc_id").alias("home"), F.col("text").alias("home_text")), "home").select("doc_id", "home_text")
    both = led.join(held(later), "doc_id").select("doc_id", "text", "home_text")
    found = written(spark, both.mapInPandas(tidy(compare), "doc_id long, crc int, a int, b int, start long, end long, classes array<long>"))
    forget(spark, pairs, later, home)
    # Bounded by the document's own passages and the documents that it meets.
    grouped = found.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("a", "b", "start", "end", "classes")).alias("u"))
    spans = written(spark, grouped.mapInPandas(tidy(merge), f"doc_id long, crc int, spans {SPAN}"))
    forget(spark, found)
    return spans


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of ``text_col``; all columns and rows stay."""

    def apply(text, crcs, lists):
        import pandas as pd

        out = []
        for t, sums, spans_of in zip(text, crcs, lists, strict=True):
            if isinstance(t, str) and sums is not None and (own := crc(t)) in (sums := list(sums)):
                raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
                for s in spans_of[sums.index(own)]:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                parts.append(raw[at:])
                t = b"".join(parts).decode("utf-8", "surrogatepass").rstrip() if parts else t
            out.append(t)
        return pd.Series(out, dtype=object)

    edges = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    own = spans.groupBy(F.col("doc_id").alias("_fab_id")).agg(F.collect_list(F.struct("crc", edges.alias("e"))).alias("_fab"))
    own = written(docs.sparkSession, own.select("_fab_id", F.col("_fab.crc").alias("_fab_crc"), F.col("_fab.e").alias("_fab_spans")))
    udf = F.pandas_udf(apply, "string")
    held = F.aggregate("_fab_spans", F.lit(0), lambda a, x: a + F.size(x))
    joined = docs.join(small_or_shuffled(own, 32 + 8 * F.size("_fab_crc") + 16 * held), docs[id_col].cast("long") == own["_fab_id"], "left")
    return joined.withColumn("_fab_text", F.when(F.col("_fab_id").isNull(), docs[text_col]).otherwise(udf(docs[text_col], F.col("_fab_crc"), F.col("_fab_spans")))).select(*[F.col("_fab_text").alias(c) if c == text_col else docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = repeated(docs)
    # One row a document; spans of documents without any are empty. The texts themselves do not move.
    per = spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    per = written(spark, per)
    held = F.aggregate("spans", F.lit(0), lambda a, x: a + 32 + 8 * F.size(x["classes"]))
    out = docs.select("doc_id").join(small_or_shuffled(per, 32 + held), "doc_id", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,words:bigint,classes:array<bigint>>>)")
    spans = F.coalesce("spans", none)
    return out.select(
        "doc_id", F.size(spans).cast("long").alias("n_spans"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("removed_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_bytes"),
        F.transform(spans, lambda s: s["start"]).alias("span_starts"), F.transform(spans, lambda s: s["end"]).alias("span_ends"),
        F.array_distinct(F.flatten(F.transform(spans, lambda s: s["classes"]))).alias("class_ids"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; n_chars follows the text if there is such a column."""
    spans = repeated(docs)
    out = remove(docs, spans)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
