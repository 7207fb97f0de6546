"""Fusion of vector, full-text and graph results, ranking, and the hierarchical entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RETRIEVAL
from . import vectors

# The weights of the three scores, and the graph's boost.
WEIGHTS = (0.6, 0.3, 0.1)
GRAPH_SCORE = 0.1


def merge(vector: DataFrame, fts: DataFrame, graph: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """query_id, id, vector_score, fts_score, graph_score and score (6 places) of all candidates.

    ``vector`` has score (cosine), ``fts`` has score (BM25). Full-text scores are set against the query's greatest
    (1 at least): as 1 - share, as the reference semantics have it, or with ``fixed`` as the share itself. Candidates
    that the graph reached get its boost; it adds none.
    """
    best = F.greatest(F.max(F.abs("score")).over(Window.partitionBy("query_id")), F.lit(1.0))
    share = F.abs(F.col("score")) / best
    lexical = fts.select("query_id", "id", (share if fixed else 1 - share).alias("fts_score"))
    df = vector.select("query_id", "id", F.col("score").alias("vector_score")).join(lexical, ["query_id", "id"], "full_outer").fillna(0.0, ["vector_score", "fts_score"])
    if graph is None:
        df = df.withColumn("graph_score", F.lit(0.0))
    else:
        near = graph.select("query_id", "id").distinct().withColumn("graph_score", F.lit(GRAPH_SCORE))
        df = df.join(near, ["query_id", "id"], "left").fillna(0.0, ["graph_score"])
    v, f, g = WEIGHTS
    return df.withColumn("score", F.round(v * F.col("vector_score") + f * F.col("fts_score") + g * F.col("graph_score"), 6))


def ranked(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def filtered(chunks: DataFrame, languages=None, domains=None, kinds=None, tags=None, paths=None) -> DataFrame:
    """``chunks`` that meet every given filter; a path filter takes whole folders too."""
    for name, values in (("language", languages), ("domain", domains), ("kind", kinds)):
        if values:
            chunks = chunks.where(F.col(name).isin(list(values)))
    if tags:
        chunks = chunks.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if paths:
        hit = F.lit(False)
        for p in paths:
            hit = hit | (F.col("relative_path") == p) | F.startswith("relative_path", F.lit(p.rstrip("/") + "/"))
        chunks = chunks.where(hit)
    return chunks


def rerank(candidates: DataFrame, k: int, scorer=None) -> DataFrame:
    """The ``k`` best candidates by ``scorer`` (a function from (query, text) columns to a column); without one, by their fused score."""
    if scorer is None:
        return ranked(candidates, k)
    return ranked(candidates.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 6)), k, "rerank_score")


def hierarchical(queries: DataFrame, chunks: DataFrame, k: int = RETRIEVAL.final_top_k, levels=(("module", 3), ("file", 10))) -> DataFrame:
    """query_id, id, score and rank of the best ``k`` ``chunks`` (id, embedding and a column for each level) of each of ``queries`` (query_id, vector).

    Each level takes the best groups by their mean vector, but only among groups inside what the level above chose for
    that query; at last the chunks of the chosen groups are ranked, all of them. Without levels the search is flat.
    """
    outer = None
    for level, best in levels:
        groups = vectors.centroids(chunks, level).select(F.col("id").alias(level), "embedding")
        if outer is not None:
            groups = groups.join(chunks.select(level, outer).distinct(), level)
        found = vectors.top_k(queries, groups.select("*", F.col(level).alias("id")).drop(level), best, by=outer)
        queries = queries.select("query_id", "vector").distinct().join(found.select("query_id", F.col("id").alias(level)), "query_id")
        outer = level
    return vectors.top_k(queries, chunks, k, by=outer)
