"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of character trigrams and repeated words, projected on the leading singular vectors of a
bounded labelled sample. The sample's vectors go to every task; each block of documents takes its exact cosine
products with all of them, and the nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

#: Bound of the labelled documents of each class, by a hash of the id.
TRAIN_ROWS = 1500
BUCKETS = 2048
EXTRA = 8
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8.0
BLOCK = 256
THRESHOLD = 0.3
_MIX = np.uint32(2654435761)


def features(text: str | None) -> np.ndarray:
    """Counts of a whole text: hashed byte trigrams (letters in lower case), then shares of what trigrams do not show."""
    out = np.zeros(BUCKETS + EXTRA, dtype=np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    b = np.frombuffer(raw.lower(), dtype=np.uint8)
    if len(b) >= 3:
        x = b.astype(np.uint32)
        h = ((x[:-2] << np.uint32(16)) ^ (x[1:-1] << np.uint32(8)) ^ x[2:]) * _MIX >> np.uint32(32 - 11)
        out[:BUCKETS] = np.log1p(np.bincount(h, minlength=BUCKETS))
        norm = np.linalg.norm(out)
        out[:BUCKETS] /= norm or 1.0
    words = raw.split()
    n = max(len(words), 1)
    a = np.frombuffer(raw, dtype=np.uint8)
    distinct = len(set(words)) / n
    same = sum(x == y for x, y in zip(words, words[1:])) / n
    upper = ((a >= 65) & (a <= 90)).mean()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = np.isin(a, np.frombuffer(b"#*$%&|<>!{}[]=~^", dtype=np.uint8)).mean()
    out[BUCKETS:] = distinct, same, upper, len(set(lines)) / max(len(lines), 1), marks, np.log1p(n) / 10, min(1.0, len(raw) / n / 20), ((a >= 48) & (a <= 57)).mean()
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    axes: np.ndarray  # features to latent space
    vectors: np.ndarray  # unit rows, one for each labelled document
    votes: np.ndarray  # class weight of each, negative for label 0
    prior: float


def gathered(labelled: DataFrame, label: str) -> DataFrame:
    """The feature vectors of the labelled sample."""

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("y")], ["x", "y"])

    known = labelled.where(F.col(label).isNotNull()).select("doc_id", "text", F.col(label).cast("int").alias("y"))
    return known.select("text", "y").mapInArrow(run, "x binary, y int")


def of_sample(docs: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """The documents of ``known`` (see ``sample``) with their labels; of rows with one id the least text."""
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))  # 2 * TRAIN_ROWS ids


def sample(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Ids and labels of at most ``rows`` documents of each class. Of a document's labels the lowest counts."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [own.where(F.col(label) == y).orderBy(*order).limit(rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(labelled: DataFrame, label: str = "quality", rank: int = RANK) -> Model | None:
    """Latent axes and vectors of ``labelled`` (doc_id, text, label), which the caller has bounded (see ``sample``); None without rows."""
    got = gathered(labelled, label).collect()  # 8 kB a row, at most 2 * TRAIN_ROWS of them
    if not got:
        return None
    x, y = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got]).astype(np.float64), np.array([r["y"] for r in got])
    # The order of rows that Spark gathers varies; sums over them should not.
    order = np.lexsort((*x[:, :6].T, y))
    x, y = x[order], y[order]
    mean = x.mean(axis=0)
    spread = np.concatenate([np.ones(BUCKETS), 1 / (x[:, BUCKETS:].std(axis=0) + 0.05) / 4])
    centred = (x - mean) * spread
    values, axes = np.linalg.eigh(centred @ centred.T)
    keep = np.argsort(values)[::-1][: min(rank, len(x))]
    keep = keep[values[keep] > 1e-9]
    if not len(keep):
        keep = np.array([len(values) - 1])
    axes = (centred.T @ axes[:, keep]) / np.sqrt(np.maximum(values[keep], 1e-9))
    axes = axes * spread[:, None]
    z = (x - mean) @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    n1, n0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    votes = np.where(y == 1, len(y) / (2 * n1), -len(y) / (2 * n0))
    if len(set(y.tolist())) == 1:
        votes = np.where(y == 1, 1.0, -1.0)
    return Model(mean, axes, z, votes, 0.5)


def vote(x: np.ndarray, model: Model, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of feature rows: the exact cosine products with all labelled vectors, the k nearest weighted; all that are as near as the k-th count.

    Products are taken in doubles and cosines rounded to six places, so that neither depends on the size of the block.
    """
    z = (x.astype(np.float64) - model.mean) @ model.axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    near = np.round(z @ model.vectors.T, 6) + 0.0
    k = min(k, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    w = np.where(near >= least, np.exp(SHARPNESS * near) * np.abs(model.votes), 0)
    return np.round(w[:, model.votes > 0].sum(axis=1) / np.maximum(w.sum(axis=1), 1e-9), 9)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document, by its whole text.

    Null and empty texts have no features and are voted on like any other; with nothing labelled every score is 0.5.
    Repeated rows get equal scores; an empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * TRAIN_ROWS vectors

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, out = batch.column("text"), []
            for at in range(0, len(texts), BLOCK):
                block = np.stack([features(t.as_py()) for t in texts[at : at + BLOCK]])
                out.append(vote(block, m) if m else np.full(len(block), 0.5))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op1_quality_knn(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    known = sample(labels.where(~held_out(F.col("doc_id"), 5, 0)), "quality")
    model = fit(of_sample(docs, known, "quality"))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
