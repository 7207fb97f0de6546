"""Models behind a protocol: embedders and rerankers that are called with batches, and a stored cache of embeddings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..sources.store import Commit, Store
from .fusion import ranked

#: A call takes so many texts at most, of so many characters together (a longer text is a call of its own).
BATCH_ROWS, BATCH_CHARS = 32, 200_000
#: Further attempts after a failure, and the seconds before the first of them, which double each time.
RETRIES, WAIT = 3, 0.2
#: Candidates that one call of a reranker takes.
RERANK_ROWS = 100

#: list of texts to list of vectors; list of texts and a query to list of scores. Both must be picklable.
Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[str, list[str]], list[float]]


def with_retries(call: Callable, *args, retries: int = RETRIES, wait: float = WAIT):
    """``call(*args)``, again after a failure, with doubled waits; the last failure is raised."""
    for attempt in range(retries + 1):
        try:
            return call(*args)
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)


def calls_of(texts: list[str], rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(begin, end) of each call: a call closes before the text that would take it over either limit."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin >= rows or size + len(t) > chars):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def embedded(texts: DataFrame, embed: Embedder, rows: int = BATCH_ROWS, chars: int = BATCH_CHARS, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """``texts`` (with ``text``) with ``embedding``; null texts count as empty. ``embed`` is called once for each batch, inside the tasks."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    def run(batches):
        for batch in batches:
            own = [t or "" for t in batch.column("text").to_pylist()]
            out = []
            for a, b in calls_of(own, rows, chars):
                vectors = with_retries(embed, own[a:b], retries=retries, wait=wait)
                if len(vectors) != b - a:
                    raise ValueError(f"{len(vectors)} vectors for {b - a} texts")
                out += vectors
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields]).add("embedding", ArrayType(DoubleType())))


class EmbeddingCache:
    """Embeddings by the hash of their text, stored; beyond ``max_bytes`` the oldest runs' go."""

    def __init__(self, store: Store, name: str = "embeddings", max_bytes: int | None = None):
        self.store, self.name, self.max_bytes = store, name, max_bytes

    def embed(self, docs: DataFrame, embed: Embedder, **kw) -> DataFrame:
        """``docs`` (with ``text``) with ``embedding``. Each distinct text that the cache lacks is embedded once and stored first."""
        keyed = docs.withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")), 256))

        def change(c: Commit) -> None:
            known = c.read(self.name)
            once = keyed.groupBy("_hash").agg(F.first("text").alias("text"))
            new = once if known is None else once.join(known.select(F.col("hash").alias("_hash")), "_hash", "left_anti")
            made = embedded(new, embed, **kw).select(F.col("_hash").alias("hash"), "embedding", F.lit(c.version).alias("run"), (F.size("embedding") * 8).cast("long").alias("bytes"))
            c.upsert(self.name, made, ["hash"])

        self.store.commit(change)
        found = self.store.read(self.name).select(F.col("hash").alias("_hash"), "embedding")
        out = keyed.join(found, "_hash").drop("_hash")
        return out

    def runs(self) -> DataFrame:
        """run, entries and bytes: what each run has added and is still there."""
        return self.store.read(self.name).groupBy("run").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"))

    def evict(self) -> None:
        """Keep the newest runs that fit ``max_bytes`` together. The driver sees one row for each run."""
        if self.max_bytes is None:
            return
        total, gone = 0, []
        for r in self.runs().orderBy(F.desc("run")).collect():
            total += r["bytes"]
            if total > self.max_bytes:
                gone.append(r["run"])
        if gone:
            self.store.commit(lambda c: c.delete(self.name, c.read(self.name).where(F.col("run").isin(gone)).select("hash")))


def reranked(candidates: DataFrame, score: Scorer, k: int = RETRIEVAL.final_top_k, available: Callable[[], bool] | None = None, candidates_each: int = RETRIEVAL.candidates, rows: int = RERANK_ROWS, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """``candidates`` (query_id, query, id, text, score) with ``rerank_score`` and ``rank``: the best ``k`` of each query.

    Of each query the best ``candidates_each`` by their fused score go to ``score``, ``rows`` in a call. If ``available``
    says no, and for queries whose call fails after all attempts, the fused order stays and rerank_score is null.
    """
    best = ranked(candidates, candidates_each)
    fused = best.withColumn("rerank_score", F.lit(None).cast("double"))
    if available is not None and not available():
        return fused.where(F.col("rank") <= k)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank")
        texts, out = [t or "" for t in own["text"]], []
        try:
            for a in range(0, len(texts), rows):
                out += with_retries(score, own["query"].iloc[0], texts[a : a + rows], retries=retries, wait=wait)
        except Exception:  # the model is a service: its answer may be missing
            out = [None] * len(texts)
        return own.assign(rerank_score=pd.Series(out, index=own.index, dtype="float64"))

    scored = best.groupBy("query_id").applyInPandas(run, fused.schema).drop("rank").withColumn("rerank_score", F.round("rerank_score", 6))
    return _ordered(scored).where(F.col("rank") <= k)


def _ordered(scored: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    order = [F.col("rerank_score").desc_nulls_last(), F.desc("score"), "id"]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
