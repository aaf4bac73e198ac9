"""Operator 1: toxicity by a classifier chain of linear models.

The label columns named by ``categories`` are predicted one after the other (by default quality, then toxic), the last
one is judged. Each model is a logistic regression on hashed words and word beginnings; it also gets the earlier
categories' probabilities. In training those come from models fitted without the document's fold, features included
(out of fold), so that a later model sees earlier ones' errors as they will be.

Training uses at most ``MAX_TRAIN`` labelled documents with and without the last category (those of the smallest hashes
of doc_id), the one bound here; scoring covers all documents. A model uses every feature of three training documents or
more whose shares in the two classes differ by ``SIGMAS`` standard errors. The decision threshold is the one with the
best out-of-fold F1.

Defined results: a null text is an empty text and not toxic unless the labels say that such texts are; repeated rows
give repeated results; labels that are null do not train their category (a null in the last one: the row is not used),
a document with labels that differ counts as having the category; without any labels, or with one class only, every
probability is that class's rate, and nothing is rejected if that is so of the last. An empty table gives an empty
table; other columns are ignored in ``score`` and kept in ``stage``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, clean, mix, slices, span_hashes, tidy, written

MAX_TRAIN, FOLDS, DIMENSIONS, STEM, SIGMAS = 2500, 4, 1 << 20, 5, 3.0
CATEGORIES = ("quality", "toxic")
#: The chain that a Python worker used last, by its token.
_unpacked: dict[str, Chain] = {}
CACHES = [_unpacked]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, and offsets: all words, and the first bytes of longer words."""
    w = Words(texts)
    text = w.text_of_word()
    long = np.flatnonzero(w.end - w.start > STEM)
    begins = mix(span_hashes(w.sums, w.start[long], w.start[long] + STEM) + np.uint64(77))
    every = np.concatenate([w.hash, begins]) & np.uint64(DIMENSIONS - 1)
    key = np.unique(np.concatenate([text, text[long]]).astype(np.uint64) * np.uint64(DIMENSIONS) + every)
    return (key & np.uint64(DIMENSIONS - 1)).astype(np.int64), np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) * np.uint64(DIMENSIONS))


@dataclass
class Chain:
    """Weights by feature for each category, of the earlier probabilities, biases, and the threshold."""

    weights: np.ndarray  # DIMENSIONS x categories, float32
    earlier: list[np.ndarray]
    bias: list[float]
    threshold: float

    def predict(self, found: np.ndarray, offset: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(offset) - 1, len(self.bias)))
        full = np.flatnonzero(np.diff(offset) > 0)
        if len(full):
            sums[full] = np.add.reduceat(self.weights[found], offset[:-1][full], axis=0, dtype=np.float64)
        out = np.zeros_like(sums)
        for k in range(len(self.bias)):
            out[:, k] = sigmoid(sums[:, k] + out[:, :k] @ self.earlier[k] + self.bias[k])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(columns: np.ndarray, rows: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, size: int, penalty: float = 0.5, turns: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on 0/1 features plus dense ``extra`` columns, by Nesterov's accelerated gradient steps."""
    dense = np.column_stack([extra, np.ones(n)])

    def forward(w, v):
        return np.bincount(rows, weights=w[columns], minlength=n) + dense @ v

    def back(e):
        return np.bincount(columns, weights=e[rows], minlength=size), dense.T @ e

    w, v = np.ones(size), np.ones(dense.shape[1])
    for _ in range(12):  # the largest curvature, by power iteration
        norm = np.sqrt(w @ w + v @ v)
        w, v = back(forward(w / norm, v / norm))
    step = 1.0 / (0.27 * np.sqrt(w @ w + v @ v) + penalty)
    w = pw = np.zeros(size)
    v = pv = np.zeros(dense.shape[1])
    v = v + np.append(np.zeros(extra.shape[1]), np.log((y.mean() + 1e-3) / (1.001 - y.mean())))
    pv = v
    for turn in range(turns):
        push = turn / (turn + 3)
        tw, tv = w + push * (w - pw), v + push * (v - pv)
        pw, pv = w, v
        gw, gv = back(sigmoid(forward(tw, tv)) - y)
        w = tw - step * (gw + penalty * tw)
        v = tv - step * (gv + np.append(penalty * tv[:-1], 0.0))
    return w, v[:-1], float(v[-1])


def telling(found: np.ndarray, rows: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
    """The features whose shares among documents with and without the category differ beyond chance."""
    yes, no = max(1.0, y.sum()), max(1.0, n - y.sum())
    with_it = np.bincount(found, weights=y[rows], minlength=DIMENSIONS)
    count = np.bincount(found, minlength=DIMENSIONS)
    share = count / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / yes + 1 / no))
    differ = np.abs(with_it / yes - (count - with_it) / no) >= SIGMAS * error
    return np.flatnonzero(differ & (count >= 3) & (count <= 0.2 * n))  # a word in a fifth of all documents tells little


def model(found: np.ndarray, rows: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(features, weights, weights of ``extra``, bias) of a model of y; a rate where y has one class."""
    if not n or y.min() == y.max():
        rate = float(y.mean()) if n else 0.0
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(extra.shape[1]), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    chosen = telling(found, rows, n, y)
    slot = np.full(DIMENSIONS, -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[found] >= 0
    w, v, b = fit(slot[found[keep]], rows[keep], n, extra, y, max(1, len(chosen)))
    return chosen, w[: len(chosen)], v, b


def train(texts: list[str], labels: np.ndarray) -> Chain:
    """``labels``: a column of 0, 1 or NaN for each category, the last without NaN."""
    n, kinds = labels.shape
    if n == 0 or labels[:, -1].min() == labels[:, -1].max():
        rate = float(labels[:, -1].mean()) if n else 0.0
        logit = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        return Chain(np.zeros((DIMENSIONS, kinds), dtype=np.float32), [np.zeros(k) for k in range(kinds)], [logit] * kinds, 2.0)
    parts = [(i, j, *features(texts[i:j])) for i, j in slices(texts)]
    found = np.concatenate([p[2] for p in parts])
    rows = np.concatenate([np.repeat(np.arange(i, j), np.diff(at)) for i, j, _, at in parts])
    fold = np.arange(n) % FOLDS
    weights = np.zeros((DIMENSIONS, kinds), dtype=np.float32)
    earlier, bias = [], []
    held_out = np.zeros((n, kinds))

    def learn(k, used):
        """A model of category k from the documents ``used`` that have its label."""
        used = used & ~np.isnan(labels[:, k])
        mine = used[rows]
        back = np.cumsum(used) - 1
        return model(found[mine], back[rows[mine]], int(used.sum()), held_out[used, :k], labels[used, k])

    for k in range(kinds):
        for f in range(FOLDS):
            chosen, w, v, b = learn(k, fold != f)
            own = np.zeros(DIMENSIONS)
            own[chosen] = w
            z = np.bincount(rows, weights=own[found], minlength=n) + held_out[:, :k] @ v + b
            held_out[fold == f, k] = sigmoid(z)[fold == f]
        chosen, w, v, b = learn(k, np.ones(n, dtype=bool))
        weights[chosen, k] = w
        earlier.append(v)
        bias.append(b)
    toxic = labels[:, -1]
    order = np.argsort(-held_out[:, -1], kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + toxic.sum())
    best = int(f1.argmax())
    p = held_out[order, -1]
    return Chain(weights, earlier, bias, float((p[best] + p[min(best + 1, n - 1)]) / 2))


def training_rows(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, limit: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """At most ``limit`` labelled documents of each class, by hash of doc_id; the driver holds no more than those."""
    spark = docs.sparkSession
    last = F.col(categories[-1])
    known = labels.where(F.col("doc_id").isNotNull() & last.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"c{k}") for k, c in enumerate(categories)])
    judged, order = F.col(f"c{len(categories) - 1}"), [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(judged == c).orderBy(*order).limit(limit) for c in (1, 0)]
    some = written(spark, some[0].unionByName(some[1]))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # 2 * limit rows at most: a bounded broadcast.
    rows = own.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(*[F.max(f"c{k}").alias(f"c{k}") for k in range(len(categories))], F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted(rows.collect(), key=lambda r: (mix(np.array([r["doc_id"]], dtype=np.int64).astype(np.uint64)).item(), r["doc_id"]))
    table = np.array([[r[f"c{k}"] for k in range(len(categories))] for r in rows], dtype=float)
    return [r["text"] for r in rows], table.reshape(-1, len(categories))


def score(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last category is over its threshold). One row per row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    packed = spark.sparkContext.broadcast(pack(train(*training_rows(docs, labels, categories))))

    def run(batches):
        import pandas as pd

        own = unpack(packed.value)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), clean(batch["text"])
            for i, j in slices(texts):
                p = own.predict(*features(texts[i:j]))
                yield pd.DataFrame({"doc_id": ids[i:j], **{f"p_{c}": np.round(p[:, k], 6) for k, c in enumerate(categories)}, "toxic": p[:, -1] >= own.threshold})

    # Ids pass pandas as strings: a null would make numbers of them that lose digits.
    schema = "doc_id string, " + ", ".join(f"p_{c} double" for c in categories) + ", toxic boolean"
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").alias("text")).mapInPandas(tidy(run), schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(chain: Chain) -> tuple:
    """A token, and the chain without features that have no weight."""
    used = np.flatnonzero(chain.weights.any(axis=1))
    return uuid.uuid4().hex, used, chain.weights[used], chain.earlier, chain.bias, chain.threshold


def unpack(packed: tuple) -> Chain:
    token, used, values, earlier, bias, threshold = packed
    if token not in _unpacked:
        weights = np.zeros((DIMENSIONS, len(bias)), dtype=np.float32)
        weights[used] = values
        _unpacked.clear()
        _unpacked[token] = Chain(weights, earlier, bias, threshold)
    return _unpacked[token]


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, with all their columns. Rows are judged by their own text."""
    import pandas as pd

    bounded_batches(spark)
    packed = spark.sparkContext.broadcast(pack(train(*training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))))

    def judge(text):
        own, texts = unpack(packed.value), clean(text)
        out = np.zeros(len(texts), dtype=bool)
        for i, j in slices(texts):
            out[i:j] = own.predict(*features(texts[i:j]))[:, -1] >= own.threshold
        return pd.Series(out)

    judged = F.pandas_udf(judge, "boolean")
    return docs.where(~judged("text"))
