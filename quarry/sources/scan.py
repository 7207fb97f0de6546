"""Reading a source tree, and comparing it with what was seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, text

MAX_BYTES = 10 << 20
IGNORE_FILES = (".gitignore", ".ragignore")


def scan_directory(spark: SparkSession, root: str, extra_ignored: list[str] = (), max_bytes: int = MAX_BYTES, include_binary: bool = False) -> DataFrame:
    """A row for each file under ``root`` that neither its ignore files, the extra patterns nor the fixed ones leave out (in this order, so that nothing takes back in what the fixed ones exclude): path, relative_path, content, hash, size, language and the rest of its fingerprint."""
    base = "file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    raw = raw.withColumn("relative_path", F.expr(f"substring(path, {len(base) + 2})"))
    raw = raw.where(~files.ignored(F.col("relative_path"), [*ignore_lines(spark, root), *extra_ignored, *files.IGNORED]))
    return fingerprints(raw.withColumn("modified_time", F.unix_millis("modificationTime").cast("double")), include_binary)


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of the root's own ignore files. Spark's readers pass over names with a leading dot, so the driver opens these two."""
    jvm, out = spark.sparkContext._jvm, []
    for name in IGNORE_FILES:
        path = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            stream = fs.open(path)
            try:
                out += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return out


def fingerprints(raw: DataFrame, include_binary: bool = False) -> DataFrame:
    """``raw`` has relative_path, content (binary) and modified_time."""
    lang = files.language_of(F.col("relative_path"))
    binary = files.is_binary_path(F.col("relative_path")) | files.has_binary_bytes(F.col("content"))
    df = raw.withColumn("language", lang).withColumn("is_binary", binary).select(
        "relative_path", "content", "modified_time", "language", "is_binary", files.category_of(F.col("language")).alias("category"),
        text.short_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"),
        files.encoding_of(F.col("content")).alias("encoding"), files.mime_of(F.col("language"), F.col("is_binary")).alias("mime_type"),
    )
    return df if include_binary else df.where("NOT is_binary")


def delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``path`` and ``status`` (new, modified, unchanged, deleted) from fingerprints with path, hash and modified_time."""
    c, p = current.select("path", F.col("hash").alias("h"), F.col("modified_time").alias("m")), previous.select("path", F.col("hash").alias("h0"), F.col("modified_time").alias("m0"))
    status = F.when(F.col("h0").isNull(), "new").when(F.col("h").isNull(), "deleted").when((F.col("h") != F.col("h0")) | (F.col("m") != F.col("m0")), "modified").otherwise("unchanged")
    return c.join(p, "path", "full_outer").select("path", status.alias("status"))


def last_of(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, else the greatest by all columns that can be compared."""
    comparable = [c for c, t in rows.dtypes if "map<" not in t and t != "variant"]
    by = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in comparable])
    row = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), by).alias("row")
    return rows.groupBy(*keys).agg(row).select("row.*")


def upsert(stored: DataFrame, changed: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``stored`` with the rows of ``changed`` in place of those with the same keys; of several with one key the last counts (see ``last_of``)."""
    changed = last_of(changed, keys, order)
    return stored.join(changed.select(*keys), keys, "left_anti").unionByName(changed)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys), keys, "left_anti")


class Snapshots:
    """Versioned Parquet tables: each write is a new folder, and readers take the newest finished one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        jvm = self.spark.sparkContext._jvm
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        version = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")
        return self.read(name)

    def read(self, name: str) -> DataFrame | None:
        versions = self.versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}") if versions else None

    def prune(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, which readers may still be at."""
        for version in self.versions(name)[:-keep]:
            fs, path = self._fs(f"{self.root}/{name}/v{version}")
            fs.delete(path, True)

    def upsert(self, name: str, changed: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
        stored = self.read(name)
        return self.write(name, last_of(changed, keys, order) if stored is None else upsert(stored, changed, keys, order))

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> DataFrame | None:
        stored = self.read(name)
        return None if stored is None else self.write(name, delete(stored, gone, keys))
