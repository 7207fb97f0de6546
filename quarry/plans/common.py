"""What the queries share: the test tables as files, queries and chunks, and a builder of literal tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a session on one machine may leave it unset and gets one beside its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-intermediate").rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than that, for work that is bound by the CPU."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


@contextmanager
def store_of(spark: SparkSession) -> Iterator[tuple[Store, Callable[[DataFrame], DataFrame]]]:
    """A new store in the shared folder, and a function that writes a result beside it and reads it back. At the end the store is deleted; of the result only what was given to the function is left."""
    root = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/store")

    def kept(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/result")
        return spark.read.schema(df.schema).parquet(f"{root}/result")

    try:
        yield store, kept
    finally:
        store.remove("")


def values(rows: list[tuple], names: str) -> str:
    """A literal table for DuckDB."""
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Questions of each intent, overlaps, accents, punctuation, and one that is empty once cleaned.
QUESTIONS = [
    (1, "How does the auth middleware work?"), (2, "where is the session token used"), (3, "architecture overview of the api"),
    (4, "what is a repository"), (5, "config options for cache"), (6, "unit test for login"), (7, "readme guide"), (8, "fix bug in queue worker"),
    (9, "how to fix bug"), (10, "Ação   database ERROR!"), (11, "   "), (12, "*** ()"), (13, "deploy: security & validate; log(error)"), (14, "the and of"),
]


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("relative_path"), F.col("text").alias("content"))


FILES = "files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS relative_path, text AS content FROM documents)"
