"""Stored tables that change by small parts.

Rows of a keyed table lie in buckets by a hash of their key. A change writes anew only the buckets that it touches, a
log only what is appended, and one manifest publishes all tables of a commit at once. Manifests are numbered files that
are never overwritten: readers see a commit whole or not at all, and of two writers at once the second fails. A commit
may carry a stream's batch id; a batch that comes again is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scan import last_of

BUCKETS = 32
BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _matched(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """``rows`` joined with distinct ``keys``; nulls are equal."""
    other = keys.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(names)])
    return rows.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(names))), how)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def names(self, folder: str) -> list[str]:
        """Names in a folder of the store, in order."""
        fs, path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def remove(self, folder: str) -> None:
        fs, path = self._path(f"{self.root}/{folder}")
        fs.delete(path, True)

    def manifest(self) -> dict:
        """The newest manifest: version, streams (the last batch of each) and tables."""
        found = [n for n in self.names("manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, "streams": {}, "tables": {}}
        fs, path = self._path(f"{self.root}/manifests/{found[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Write the manifest aside and give it its name; fails if that is taken."""
        fs, aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        _, path = self._path(f"{self.root}/manifests/{manifest['version']:020d}.json")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(aside), fs.makeQualified(path), options)

    def read(self, name: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table as the newest manifest has it, or only some of its buckets; None where there is no such table."""
        own = (manifest or self.manifest())["tables"].get(name)
        if own is None:
            return None
        schema = StructType.fromJson(own["schema"])
        paths = [f"{self.root}/{p}" for b, ps in sorted(own["parts"].items()) if buckets is None or int(b) in buckets for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def status(self, names: list[str]) -> dict[str, int | None]:
        """The number of rows of each table; None for those that are missing."""
        manifest = self.manifest()
        return {n: None if (t := self.read(n, manifest=manifest)) is None else t.count() for n in names}

    def lookup(self, name: str, wanted: DataFrame) -> DataFrame | None:
        """The rows of a keyed table whose keys are among ``wanted``; only their buckets are read."""
        manifest = self.manifest()
        own = manifest["tables"].get(name)
        if own is None:
            return None
        keys = wanted.select(*own["keys"]).distinct()
        stored = self.read(name, touched(keys, own["keys"], own["buckets"]), manifest)
        return _matched(stored, keys, own["keys"], "left_semi")

    def commit(self, change: Callable[[Commit], None], stream: str | None = None, batch_id: int | None = None) -> bool:
        """Run ``change`` and publish what it did. With a stream's batch id that is not beyond its last one, nothing is done and the result is False."""
        manifest = self.manifest()
        if stream is not None and manifest["streams"].get(stream, -1) >= batch_id:
            return False
        own = Commit(self, manifest)
        try:
            change(own)
            if stream is not None:
                own.manifest["streams"][stream] = batch_id
            self.publish(own.manifest)
        finally:
            self.remove(f"staged/{own.token}")
        return True

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` manifests, and folders that none of these names. Not while others write."""
        found = [n for n in self.names("manifests") if n.endswith(".json")]
        for n in found[:-keep]:
            self.remove(f"manifests/{n}")
        used = set()
        for n in found[-keep:]:
            fs, path = self._path(f"{self.root}/manifests/{n}")
            stream = fs.open(path)
            try:
                tables = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
            finally:
                stream.close()
            used |= {p for t in tables.values() for ps in t["parts"].values() for p in ps}
        for name in self.names("data"):
            for part in self.names(f"data/{name}"):
                whole = f"data/{name}/{part}"
                inner = {p for p in used if p == whole or p.startswith(whole + "/")}
                if not inner:
                    self.remove(whole)
                elif whole not in inner:
                    for b in self.names(whole):
                        if f"{whole}/{b}" not in inner:
                            self.remove(f"{whole}/{b}")


def touched(keys: DataFrame, names: list[str], buckets: int) -> list[int]:
    """The buckets of these keys: never more numbers than there are buckets."""
    return [r[0] for r in keys.select(bucket_of(names, buckets).alias(BUCKET)).distinct().collect()]


class Commit:
    """Changes to the tables of a store that are published together. Columns named ``_bucket`` are refused."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest
        self.manifest["version"] += 1
        self.version, self.token = manifest["version"], uuid.uuid4().hex
        self._n = 0

    def read(self, name: str) -> DataFrame | None:
        """A table as this commit has it so far."""
        return self.store.read(name, manifest=self.manifest)

    def _staged(self, rows: DataFrame) -> DataFrame:
        """``rows``, computed once; as large as the change."""
        if BUCKET in rows.columns:
            raise ValueError(f"a column named {BUCKET}")
        self._n += 1
        path = f"{self.store.root}/staged/{self.token}/{self._n}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def _write(self, name: str, rows: DataFrame, keys: list[str] | None, buckets: int, sort: list[str]) -> dict[str, list[str]]:
        """A new folder of the table, a folder inside for each bucket if there are keys; where its parts lie."""
        self._n += 1
        folder = f"data/{name}/c{self.version}-{self.token[:8]}-{self._n}"
        path = f"{self.store.root}/{folder}"
        if not keys:
            (rows.sortWithinPartitions(*sort) if sort else rows).write.parquet(path)
            return {"0": [folder]}
        # Large buckets are split into several tasks, each with a file of its own: what a task sorts does not grow with the table.
        dealt = rows.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", F.col(BUCKET))
        dealt.sortWithinPartitions(BUCKET, *sort).write.partitionBy(BUCKET).parquet(path)
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in self.store.names(folder) if n.startswith(f"{BUCKET}=")}

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> None:
        """Rows take the place of those with the same keys (nulls are equal); of several with one key the last by ``order`` counts (without it, see ``last_of``)."""
        changed = self._staged(last_of(rows, keys, order))
        own = self.manifest["tables"].setdefault(name, {"keys": keys, "buckets": buckets, "schema": changed.schema.jsonValue(), "parts": {}})
        self._rewrite(name, own, changed.select(*keys), changed)

    def delete(self, name: str, gone: DataFrame) -> None:
        """Rows with these keys go."""
        if (own := self.manifest["tables"].get(name)) is not None:
            self._rewrite(name, own, self._staged(gone.select(*own["keys"]).distinct()), None)

    def _rewrite(self, name: str, own: dict, keys: DataFrame, changed: DataFrame | None) -> None:
        hit = touched(keys, own["keys"], own["buckets"])
        if not hit:
            return
        stored = self.store.read(name, hit, self.manifest)
        left = _matched(stored, keys, own["keys"], "left_anti")
        new = self._write(name, left if changed is None else left.unionByName(changed), own["keys"], own["buckets"], own["keys"])
        for b in map(str, hit):
            own["parts"].pop(b, None)
        own["parts"].update(new)

    def append(self, name: str, rows: DataFrame, by: list[str] | None = None, buckets: int = BUCKETS, sort: list[str] = ()) -> DataFrame:
        """Rows are added to a log, and given back as they were written. With ``by`` they lie in buckets, so that readers of some keys pass over the others."""
        own = self.manifest["tables"].setdefault(name, {"keys": by, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": {}})
        new = self._write(name, rows, own["keys"], own["buckets"], list(sort))
        for b, parts in new.items():
            own["parts"].setdefault(b, []).extend(parts)
        return self.store.read(name, manifest={"tables": {name: {**own, "parts": new}}})

    def clear(self, name: str) -> None:
        """A table without rows; its files stay for readers of older manifests."""
        if name in self.manifest["tables"]:
            self.manifest["tables"][name]["parts"] = {}
