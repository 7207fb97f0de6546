"""Near duplicates by the Jaccard similarity of sets of five-word shingles: every pair of 0.8 and more is found.

SimHash fingerprints of the sets, linked as in ``simhash``, propose groups, and each member is compared with its
group's first: so large families of near copies become one component early. What fingerprints miss, a prefix filter
finds: with shingles in one order for all sets, rare ones first, two sets of similarity t must share one of the first
n - ceil(t n) + 1 shingles of each. Sets of different components that share one are compared by size and by a bitmap
of parities, both of which only bound the similarity from above, and at last by the sets themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, scratch
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: One text in so many tells which shingles are frequent, and the most of these that all tasks get (four megabytes). Both only bear on the order.
SAMPLE, FREQUENT = 16, 1 << 18
#: Words of 64 parities.
WORDS = 8
NAMES = [f"s{j}" for j in range(WORDS)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of 64-bit hashes of a whole text's shingles; a text of fewer than five words is one shingle."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def parities(h: np.ndarray) -> np.ndarray:
    """For each of WORDS * 64 classes of hashes whether the set has an odd number of them: sets that differ in d hashes differ in at most d parities."""
    at = ((h * _ODD) >> np.uint64(64 - (64 * WORDS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8), bitorder="little").view("<i8")


def fine_parities(h: np.ndarray) -> bytes:
    """Parities of at least twice as many classes as the set has hashes, so that they tell large sets apart too."""
    bits = max(64, 1 << (2 * len(h)).bit_length())
    at = ((h * _ODD) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many parities two sets differ, at the coarser of their classes: never more than in hashes."""
    x, y = (np.unpackbits(np.frombuffer(v, dtype=np.uint8), bitorder="little") for v in sorted((a, b), key=len))
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)
    return int((x ^ y).sum())


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles by which a set meets every set that is similar enough: the first ones by frequency (of ``common``, sorted; others come first), then by hash."""
    if not len(h):
        return h
    often = np.zeros(len(h), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        often = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, often))[: len(h) - math.ceil(SIMILARITY * len(h) - 1e-9) + 1]]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _located(docs: DataFrame) -> DataFrame:
    """``row`` (a document's own columns) with the file and the place that it lies at. What does not come from Parquet files is written first."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    at = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    try:
        if "_metadata" not in docs.columns:
            return docs.select(row, *at)
    except AnalysisException:  # not a scan of files
        pass
    return materialize(docs.select(row), "rows").select("row", *at)


def _ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(h.tobytes()) for h in sets), dtype=np.uint64, count=len(sets)).view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(h) for h in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, dtype=np.uint64)]).astype(np.uint64).view(np.int64)))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several distinct texts of the sample share, and how many do; at most FREQUENT, the most frequent."""

    def run(batches):
        for batch in filter(len, batches):
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([_ids(sets), _lists(sets)], ["fp", "h"])

    some = docs.select("row.text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    each = some.mapInArrow(run, "fp long, h array<long>").groupBy("fp").agg(F.first("h").alias("h"))
    found = each.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _sketched(docs: DataFrame) -> DataFrame:
    """file, place, doc_id, fp (the set's hash), n (its size), f (its SimHash), the parities (and finer ones) and the prefix of every row."""
    kind = docs.schema["row"].dataType["doc_id"].dataType.simpleString()
    common, counts = frequent(docs)

    def run(batches):
        for batch in filter(len, batches):
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            odd = np.array([parities(h) for h in sets]).reshape(-1, WORDS)
            f = np.fromiter((simhash.majority(h) for h in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
            cols = [_ids(sets), pa.array([len(h) for h in sets], pa.int64()), pa.array(f), *map(pa.array, np.ascontiguousarray(odd.T)), pa.array([fine_parities(h) for h in sets], pa.binary()), _lists([prefix(h, common, counts) for h in sets])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "place", "doc_id")), *cols], ["file", "place", "doc_id", "fp", "n", "f", *NAMES, "fine", "prefix"])

    schema = f"file long, place long, doc_id {kind}, fp long, n long, f long, " + ", ".join(f"{c} long" for c in NAMES) + ", fine binary, prefix array<long>"
    return materialize(docs.select("file", "place", "row.doc_id", "row.text").mapInArrow(run, schema), "sketched")


def _possible(a, b) -> Column:
    """Whether two sets (functions from a column's name to that side's column) may be similar enough, by their sizes and parities."""
    apart = F.bit_count(a(NAMES[0]).bitwiseXOR(b(NAMES[0])))
    for c in NAMES[1:]:
        apart = apart + F.bit_count(a(c).bitwiseXOR(b(c)))
    sizes = F.least(a("n"), b("n")) >= SIMILARITY * F.greatest(a("n"), b("n")) - 1e-9
    return sizes & (apart <= (a("n") + b("n")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9)


def _sides() -> tuple:
    return (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The ``pairs`` whose shingle sets are similar enough. Only texts of candidates are gathered."""

    def run(batches):
        for batch in batches:
            sets, keep = {}, []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "a", "b"))):
                for fp, t in ((u, a), (v, b)):
                    if fp not in sets:
                        sets[fp] = shingles(t)
                keep.append(similarity(sets[u], sets[v]) >= SIMILARITY)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def close(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "a", "b")))
            keep = [apart(a, b) <= (nu + nv) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9 for nu, nv, a, b in rows]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # First by parities as many as the sets are large, which nearly all other pairs fail, then by the texts of those left.
    a, b = (nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(t)) for k, t in (("u", "a"), ("v", "b")))
    pairs = materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "a", "b").mapInArrow(close, "u long, v long"), "close")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    need = ids.join(nodes.select("fp", "least.file", "least.place"), "fp")
    with scratch() as keep:
        texts = materialize(docs.select("file", "place", "row.text").join(need.hint("merge"), ["file", "place"]).select("fp", "text"), "texts")
        a, b = (texts.select(F.col("fp").alias(k), F.col("text").alias(t)) for k, t in (("u", "a"), ("v", "b")))
        out = materialize(pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links")
        keep(out)
    return out


def _grouped(nodes: DataFrame) -> DataFrame:
    """(u, v): possible pairs of each node with the first of its group by SimHash. Equal fingerprints are one group without a link."""
    groups = components(simhash.links(nodes.select(F.col("f").alias("fp")).distinct())).select(F.col("u").alias("f"), "root")
    own = nodes.select("fp", "f").join(groups, "f", "left").select("fp", F.coalesce("root", "f").alias("g"))
    own = materialize(own, "groups")
    first = materialize(own.groupBy("g").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "hubs")
    pairs = own.join(first.hint("merge"), "g").where("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    a, b = _sides()
    slim = nodes.select("fp", "n", *NAMES)
    return pairs.join(slim.alias("a"), F.col("u") == a("fp")).join(slim.alias("b"), F.col("v") == b("fp")).where(_possible(a, b)).select("u", "v")


def _shared(nodes: DataFrame) -> DataFrame:
    """key and fp for each shingle of a prefix that another prefix has too. Most shingles are one set's own and go here."""
    keyed = nodes.select("fp", F.explode("prefix").alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return materialize(keyed.join(several.hint("merge"), "key").select("key", "fp"), "shared")


def _mixed(shared: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``shared`` with ``root``, the component by the links ``found``, size and parities, where a key has several components. Most have one and go before rows get wide."""
    roots = components(found).withColumnRenamed("u", "fp")
    rooted = materialize(shared.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    keys = materialize(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "keys")
    left = materialize(rooted.join(keys.hint("merge"), "key"), "left")
    return materialize(left.join(nodes.select("fp", "n", *NAMES), "fp"), "mixed")


def _stars(mixed: DataFrame) -> DataFrame:
    """(u, v): possible pairs of each node with the least node of its keys."""
    hubs = materialize(mixed.groupBy("key").agg(F.min(F.struct("fp", "n", *NAMES, "root")).alias("hub")).select("key", "hub.*"), "hubs")
    a, b = _sides()
    on = (a("key") == b("key")) & (a("root") != b("root")) & _possible(a, b)
    return mixed.alias("a").join(hubs.alias("b").hint("merge"), on).select(b("fp").alias("u"), a("fp").alias("v")).distinct()


def _pairs(mixed: DataFrame) -> DataFrame:
    """(u, v): all possible pairs of nodes of different components that share a key, u < v. They are compared inside the join."""
    a, b = _sides()
    on = (a("key") == b("key")) & (a("fp") < b("fp")) & (a("root") != b("root")) & _possible(a, b)
    return mixed.alias("a").join(mixed.alias("b").hint("merge"), on).select(a("fp").alias("u"), b("fp").alias("v")).distinct()


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): similar pairs of ``nodes`` (see ``_sketched``, with least), enough of them to connect all that are connected.

    Each step only looks at what the links so far leave apart: groups by SimHash, then each prefix shingle's nodes with
    the first of them, then all pairs. So a large family is one component before any two of its members are paired.
    """
    found = _verified(materialize(_grouped(nodes), "near"), nodes, docs)
    shared = _shared(nodes)
    for tag, step in (("stars", _stars), ("pairs", _pairs)):
        found = found.unionByName(_verified(materialize(step(_mixed(shared, nodes, found)), tag), nodes, docs))
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of the least doc_id (of repeated rows with that id, any one).

    Texts with equal shingle sets are one node; texts without words are equal. A null doc_id stays only where the whole
    component has no other. An empty table gives no rows. Columns of ``docs`` travel inside ``row``, so none can clash.
    """
    located = _located(docs)
    with scratch() as keep:
        kept = _kept(located)
        keep(kept)
    return located.join(kept.hint("merge"), ["file", "place"], "left_semi").select("row.*")  # the same plan at every size


def _kept(located: DataFrame) -> DataFrame:
    """file and place of the rows that stay."""
    rows = _sketched(located)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "place")).alias("least")
    nodes = materialize(rows.groupBy("fp").agg(least, *[F.first(c).alias(c) for c in ("n", "f", *NAMES, "fine", "prefix")]), "nodes")
    roots = components(links(nodes, located)).withColumnRenamed("u", "fp")
    kept = nodes.select("fp", "least").join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least")).select("least.file", "least.place")
    return materialize(kept, "kept")
