"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words, of its character 4-grams (across word ends) and of
one feature for a word that repeats the one before it, all hashed into one table; a softmax layer reads the average.
Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the
softmax layer is linear, scoring needs only each feature's projected logit, so a document costs one table look-up a
feature; every text is read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import PART, RADIX, code_points, mix64, tidy, white, words

AGAIN = 1


@dataclass(frozen=True)
class Settings:
    """per_class bounds the training sample: at most so many labelled rows of each class, taken in the order of a hash of the id."""

    buckets_log2: int = 18
    dim: int = 8
    per_class: int = 700
    epochs: int = 20
    rate: float = 2.0
    seed: int = 7


def features(text: str, log2: int) -> np.ndarray:
    """The bucket of every feature of a text, with repeats. A text longer than PART is read in parts of that length."""
    found, shift, radix = [], np.uint64(64 - log2), np.uint64(RADIX)
    for at in range(0, len(text), PART):
        c = code_points(text[at : at + PART])
        if len(c) >= 4:
            found.append(mix64(((c[:-3] * radix + c[1:-2]) * radix + c[2:-1]) * radix + c[3:]) >> shift)
        _, _, word = words(c, white(c))
        found.append(word >> shift)
        found.append(np.full(int((word[1:] == word[:-1]).sum()), AGAIN, dtype=np.uint64))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, dtype=np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """From (buckets, their shares of the document, label): each bucket's logit and the bias. No rows: all zero."""
    rng = np.random.default_rng(s.seed)
    table = (rng.random((1 << s.buckets_log2, s.dim), dtype=np.float32) - np.float32(0.5)) / np.float32(s.dim)
    layer, bias = np.zeros((s.dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for n in rng.permutation(len(rows)):
            at, share, label = rows[n]
            vectors = table[at]
            mean = share @ vectors
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = np.float32(s.rate * (1 - done / steps))
            back = layer @ p
            layer -= step * np.outer(mean, p).astype(np.float32)
            bias -= step * np.float32(0.1) * p.astype(np.float32)
            # shares are small; scaled by their sum of squares every document moves its mean alike
            table[at] = vectors - np.outer(share * (step / max(1e-12, float(share @ share))) * np.float32(0.25), back).astype(np.float32)
            done += 1
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fold(id_col: str, folds: int) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, held_out: F.Column, s: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Train on at most 2 * per_class labelled rows outside the held-out fold. Ids with two different labels are left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    known = known.where(F.col("label") == F.col("other")).where(~held_out).select(id_col, "label")
    order = [F.xxhash64(F.col(id_col), F.lit(s.seed)), F.col(id_col)]
    picked = [known.where(F.col("label") == n).orderBy(*order).limit(s.per_class) for n in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * per_class rows of two numbers
    log2 = s.buckets_log2

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                at, n = np.unique(features(text or "", log2), return_counts=True)
                out.append((at.astype("<u4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "at": [x[0] for x in out], "share": [x[1] for x in out]})

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), id_col).select(F.col(id_col).cast("string").alias("id"), "label", "text")
    rows = texts.mapInPandas(sparse, "id string, label int, at binary, share binary").toPandas()
    rows = rows.sort_values(["id", "at"]).drop_duplicates("id")  # the order of arrival is no input of the model
    model = train([(np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.share, "<f4"), int(r.label)) for r in rows.itertuples() if len(r.at)], s)
    del rows
    tidy()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings, text_col: str = "text", into: str = "score") -> DataFrame:
    """Add the probability of label 1. An empty or null text gets the bias alone."""
    logits, bias, log2 = *model, s.buckets_log2
    held = docs.sparkSession.sparkContext.broadcast(logits)  # 4 bytes a bucket, whatever the corpus

    @F.pandas_udf(T.DoubleType())
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            z = np.array([float(held.value[at].mean(dtype=np.float64)) if len(at := features(t or "", log2)) else 0.0 for t in texts]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))
        tidy()

    return docs.withColumn(into, probability(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Every row with held_out, score (0 to 1) and predicted added.

    Labels are learnt only from rows whose crc32(id as text) mod folds is not held. Other columns pass through and are
    no input. Null or empty texts get the bias' score; a null id is not held out; repeated rows get equal scores; an
    empty table stays empty; without usable labels every score is 0.5. Output columns replace ones of the same name.
    """
    model = fit(docs, labels, fold(id_col, folds) == held, s, id_col, text_col, label_col)
    out = docs.withColumn("held_out", F.coalesce(fold(id_col, folds) == held, F.lit(False)))
    return score(out, model, s, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def crc_fold(doc_id: int, folds: int) -> int:
    """The same fold in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds
