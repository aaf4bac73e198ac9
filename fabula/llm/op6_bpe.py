"""Operator 6: BPE encoding and decoding with a pair occurrence index.

The unknown words of a batch are merged together: an index maps each pair to all its positions, the active ranks
are applied in ascending order, and the lists of the pairs next to each merge are updated (bpe.WordEncoder).
That equals merging word by word, as each merge's rank is above those that make its parts (tested on the file).

Defined results: a null text is an empty text (no ids, empty decoded text); strings of special tokens in a text
become their ids; repeated rows give repeated results; an empty table gives an empty table; other columns are
ignored. Known words are kept per Python worker, in bounded tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, clean, slices, tidy

_encoders: dict[str, bpe.WordEncoder] = {}
CACHES = [_encoders]


def encoder(path: str) -> bpe.WordEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = bpe.WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, ids (array, if ``keep``), n_tokens, ids_sha256, decoded (if ``keep``), decoded_sha256."""
    path = path or default_path()
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep

    def run(batches):
        import pandas as pd

        coder = encoder(path)
        token = coder.token
        for batch in batches:
            keys, texts = batch["doc_id"].tolist(), clean(batch["text"])
            for i, j in slices(texts):
                ids, offset = coder.encode(texts[i:j])
                rows = []
                for k in range(j - i):
                    own = ids[offset[k] : offset[k + 1]]
                    decoded = decode(own, token)
                    row = (keys[i + k], len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    rows.append((*row, own.astype(np.int64), decoded) if keep else row)
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep])

    bounded_batches(docs.sparkSession)
    # Ids pass pandas as strings: a null would make numbers of them that lose digits.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(ids, token: dict[int, str]) -> str:
    """The vocabulary has no decoder: tokens are joined by spaces; ids outside the vocabulary give nothing."""
    found = map(token.get, ids.tolist())
    return " ".join(x for x in found if x is not None)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
