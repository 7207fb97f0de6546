"""Sharding: a two-pass external shuffle in built-in operators.

Pass one scatters the records by seeded hashes into a bounded number of partitions, and inside each into buckets that
fit a task's memory, which are shuffled one at a time (``shuffle`` is a seeded Fisher-Yates); the shuffled buckets are
written to the shared folder. Pass two lays the
buckets end to end and deals positions to the shards in turn, so that shard sizes are at most one row apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

SHARDS = 24
SEED = 42
ROWS_PER_BUCKET = 4096
BYTES_PER_BUCKET = 32 << 20
#: The most partitions that pass one scatters into; beyond that a partition holds several buckets.
PARTITIONS = 8192
#: Bucket starts (16 bytes each) are broadcast up to this number, 30 TB in buckets of 32 MB, and joined beyond.
BROADCAST_BUCKETS = 1_000_000
#: Spark's aggregate that holds many groups at a time; without it sorted groups are collected one by one.
MANY_GROUPS = "spark.sql.execution.useObjectHashAggregateExec"


def sharded(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """``row`` (the record, all its columns), ``shard`` and ``slot`` (gapless from 0 in its shard), for every record.

    Nulls in any column, repeated rows and equal texts make no difference: a record's bucket comes from its place in
    the input, never from a value that many records share. An empty table gives no rows. Counts of the shards are at
    most one apart. A very long text makes buckets fewer rows long, as their number follows the bytes too.
    Up to PARTITIONS buckets have a task each; beyond, a task takes its buckets one after the other. The order follows
    the seed and the split of the input into files.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 64
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-n // ROWS_PER_BUCKET), -(-total // BYTES_PER_BUCKET))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scattered = docs.select(row, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    parts = min(buckets, PARTITIONS)
    shuffled = (
        scattered.withColumn("part", F.col("bucket") % parts).repartitionById(parts, "part").sortWithinPartitions("part", "bucket", "h")
        .groupBy("part", "bucket").agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.size("rows").alias("n"), F.shuffle("rows", F.lit(seed)).alias("rows"))
    )
    before = spark.conf.get(MANY_GROUPS)
    spark.conf.set(MANY_GROUPS, "false")
    try:
        shuffled = materialize(shuffled, "shard-buckets")
    finally:
        spark.conf.set(MANY_GROUPS, before)
    # A row for each bucket: the table of counts is thousands of times smaller than the input.
    starts = shuffled.select("bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    small = buckets <= BROADCAST_BUCKETS  # 16 bytes a bucket; beyond that an ordinary join
    placed = shuffled.join(F.broadcast(starts) if small else starts, "bucket").select("start", F.posexplode("rows").alias("i", "row"))
    at = F.col("start") + F.col("i")
    return placed.select("row", (at % n_shards).cast("int").alias("shard"), F.floor(at / n_shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 100_000, **kw) -> None:
    """Write one folder a shard (``shard=0`` on), its files in the order of the slots: ``slot``, and the record in ``row``, so that no column can clash."""
    file = F.floor(F.col("slot") / rows_per_file)
    sharded(docs, **kw).repartition(F.col("shard"), file).sortWithinPartitions("shard", "slot").select("shard", "slot", "row").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir):
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return sharded(table(spark, sf_dir, "documents")).select(
        "row.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
