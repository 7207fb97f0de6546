"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset; it then gets a folder beside its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-intermediate"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if (open_ := _open.get()) is not None:
        open_.append(out)
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffles of a query as soon as it is over: what it wrote is in the shared folder."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: The tables that the scope around ``materialize`` has to delete.
_open: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """A scope: what ``materialize`` writes inside is deleted at its end, but for the tables given to the function that it yields, which a lazy result still reads."""
    outer, kept = _open.get(), []
    token = _open.set(own := [])
    try:
        yield lambda *dfs: kept.extend(df._written for df in dfs)
    finally:
        _open.reset(token)
        forget(*(df for df in own if df._written not in kept))
        if outer is not None:
            outer += [df for df in own if df._written in kept]


def forget(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def crc_of(c: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def held_out(c: Column, parts: int, rest: int) -> Column:
    return crc_of(c) % parts == rest


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, WS), lambda x: x != "")
