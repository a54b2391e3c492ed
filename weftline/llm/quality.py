"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words and pairs of words hash into 2**18 features; a document is the unit vector
of its logarithmic counts, and its score a sparse dot product. The learner is
FTRL-proximal over a bounded sample of labelled rows, drawn by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenhash

BITS = 18
#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 4000


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's unit vector; empty without words."""
    words = tokenhash.token_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    pairs = tokenhash.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    index, count = np.unique(np.concatenate((words, pairs)) >> np.uint64(64 - BITS), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    return index.astype(np.int32), value / max(1e-9, float(np.sqrt((value * value).sum())))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pairs = [features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.tobytes() for i, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary()), part.column(2)], names=["doc_id", "index", "value", "label"])


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal updates, one example after the other."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(own) <= l1] = 0
        return w

    for _ in range(rounds):
        for index, value, label in rows:
            at, x = np.append(index, 1 << BITS), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    every = weight(np.arange((1 << BITS) + 1))
    return every[:-1].astype(np.float32), float(every[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of at most ``sample`` labelled rows (whole texts), repeated ids included; documents labelled both ways or with null are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")  # at most ``sample`` ids
    made = chosen.mapInArrow(_featurise, "doc_id long, index binary, value binary, label int")
    # ids may repeat, so rows are bounded as well
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id", "index", "value").limit(sample).collect()
    rows.sort(key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) & ((1 << 64) - 1), bytes(r["index"])))  # a fixed shuffle
    return follow_the_leader([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32), r["label"]) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row: the probability of label 1. Null and empty texts get the score of no words; nothing but the text enters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    index, value = features(text)
                    out.append(1 / (1 + np.exp(-np.clip(float(weights[index] @ value) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
