"""SimHash near-duplicates. Fingerprints are cut into three segments, so that of four differing bits at most one lies
in some segment; every segment is indexed once for each of its bits left out, and equal keys are joined and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (lowest bit, bits) of each segment: with one more differing bit than DISTANCE // 3 for none of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A hash for each shingle of a whole text, in order; a text of fewer words is one shingle, and one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    stops = ends[k - 1 :].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; zero without words."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _ones(x: Column, low: int, bits: int) -> Column:
    return F.bit_count(F.shiftright(x, low).bitwiseAND(F.lit((1 << bits) - 1)))


def signatures(fps: DataFrame, of: str = "fp") -> DataFrame:
    """``fps`` with ``key``, a row for each segment of column ``of`` and each of its bits: the segment without that bit."""
    keys = []
    for low, bits in SEGMENTS:
        part = F.shiftright(of, low).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << b))).bitwiseOR(F.lit((low + b) << 24)) for b in range(bits)]
    return fps.select("*", F.explode(F.array(*keys)).alias("key"))


def paired(keyed: DataFrame, node: str, of: str, distance: int, also=None) -> DataFrame:
    """(u, v): the pairs of ``node`` that share a key and differ in up to ``distance`` bits of column ``of``, u < v, each once.

    The distance (and ``also``, of two functions from a column's name to that side's column) is checked inside the
    join, so a bucket's candidates are never rows, and a pair that shares several keys is made at the first of them
    only. Both sides are one shuffle. Spark underestimates what the keys' explosion makes, and would broadcast a side
    of any size; the hint forbids it.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    x = a(of).bitwiseXOR(b(of))
    on = (a("key") == b("key")) & (a(node) < b(node)) & (F.bit_count(x) <= distance) & (F.shiftright(a("key"), 24) == first_key(x))
    on = on & also(a, b) if also else on
    return keyed.alias("a").join(keyed.alias("b").hint("merge"), on).select(a(node).alias("u"), b(node).alias("v"))


def first_key(x: Column) -> Column:
    """Of the keys that two fingerprints with difference ``x`` share, the number of the first: its segment's lowest bit plus the bit left out; null if they share none."""
    out = F.lit(None)
    for low, bits in reversed(SEGMENTS):
        part = F.shiftright(x, low).bitwiseAND(F.lit((1 << bits) - 1))
        at = F.when(part == 0, F.lit(low)).otherwise(F.lit(low) + F.bit_count(part - 1))
        out = F.when(F.bit_count(part) <= 1, at).otherwise(out)
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints at up to ``distance`` (at most 4) differing bits, u < v, each once (see ``paired``)."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"three segments with one bit left out find up to {DISTANCE} differing bits")
    return paired(signatures(fps.select("fp")), "fp", "fp", distance)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of every row.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so copies are never paired with each other. A null doc_id counts only where the whole
    component has no other. Repeated rows come out repeated; an empty table gives no rows. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    with scratch() as keep:
        nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        roots = components(links(nodes.select("fp"), distance)).withColumnRenamed("u", "fp")
        nodes = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
        named = materialize(nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "named")
        keep(named)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
