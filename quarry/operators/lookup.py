"""Reads of stored tables: points, nodes, summaries, payloads, and the texts that go to an embedder or a reranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fields of a vector's payload, and the defaults of those that may be missing.
PAYLOAD = (
    "chunk_id", "document_id", "relative_path", "kind", "language", "title", "summary", "tags", "token_estimate", "start_line", "end_line", "domain", "complexity",
    "is_public_api",
)
DEFAULTS = {"language": "", "domain": "unknown", "complexity": "low", "is_public_api": False}
RERANK_CHARS = 500


def points(ids: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``stored`` whose ``key`` is among ``ids``; ids without a row are left out, and an asked id counts once."""
    return stored.join(ids.select(key).distinct(), key, "left_semi").select(*stored.columns)


def with_content(candidates: DataFrame, chunks: DataFrame, content: DataFrame) -> DataFrame:
    """``candidates`` (id, ...) with the columns of ``chunks`` (id, ...) and their ``content`` (id, content); candidates without a chunk go, missing content is empty."""
    return candidates.join(chunks, "id").join(content.select("id", "content"), "id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def nodes_at(nodes: DataFrame, wanted: DataFrame, by: str = "id") -> DataFrame:
    """Nodes by ``id`` or by ``path``."""
    return points(wanted, nodes, by)


def matching(fingerprints: DataFrame, part: str) -> DataFrame:
    """Fingerprints with ``part`` anywhere in their path or absolute path."""
    return fingerprints.where(F.contains("path", F.lit(part)) | F.contains("absolute_path", F.lit(part)))


def project_of(summaries: DataFrame, project_id: str) -> DataFrame:
    return summaries.where(F.col("project_id") == project_id)


def files_of_module(summaries: DataFrame, module: str) -> DataFrame:
    """File summaries in a folder, subfolders included."""
    return summaries.where(F.startswith("path", F.lit(module + "/")))


def payload(chunks: DataFrame) -> DataFrame:
    """The fields that are kept beside a vector, defaults in place of nulls; a column that ``chunks`` lacks counts as null."""
    null = F.lit(None).cast("string")

    def field(name: str) -> Column:
        own = F.col(name) if name in chunks.columns else F.lit(None).cast("boolean") if name == "is_public_api" else null
        return (F.coalesce(own, F.lit(DEFAULTS[name])) if name in DEFAULTS else own).alias(name)

    return chunks.select(*map(field, PAYLOAD))


def batches(rows: DataFrame, size: int, by: str, order: str) -> DataFrame:
    """``rows`` with ``batch``: runs of ``size`` rows in the order of ``order``, counted anew for each value of ``by`` (a file's chunks, say), so that none spans two tasks."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order of ``order`` over the whole table.

    Rows are sorted by ranges, each range counts its own, and a range begins where those before it end: one row for each
    range goes through a single task, the rows themselves never do.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    ends = local.groupBy("_part").agg(F.max("_at").alias("_last"))
    begin = F.coalesce(F.sum(F.col("_last") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("_part", begin.alias("_begin"))
    return local.join(starts, "_part").withColumn("place", F.col("_begin") + F.col("_at")).drop("_part", "_at", "_last", "_begin")


def stream_batches(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``rows`` with ``batch``: runs of ``size`` rows in the order of ``order`` over the whole table; only the last may be smaller."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def embedding_input(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("\n"), content)


def rerank_input(title: Column, content: Column, chars: int = RERANK_CHARS) -> Column:
    return F.concat(title, F.lit("\n"), F.substring(content, 1, chars))
