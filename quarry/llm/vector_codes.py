"""Vector code compression: product codebooks by Lloyd's rounds with Hamerly's bounds (2010), all in integers.

Vectors are scaled, floored and cut into parts; each part position has a codebook of its own. Between rounds every part
keeps its entry, an upper bound of the distance to it and a lower bound of the distance to any other entry. A round
moves the bounds by what the entries have moved; only where the upper one is not strictly below the lower one is the
own distance taken anew, and only where that fails too are all entries compared. Distances are exact integers, bounds
are rounded outwards, and equal distances always reach the comparison, where the lower index wins.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest scaled component: below it all squared distances fit 64 bits.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: the entries of one part position as rows of integers; ``scale``: what components were multiplied with."""

    entries: tuple[np.ndarray, ...]
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to all entries."""
    out = np.empty((len(x), len(book)), dtype=np.int64)
    for j, entry in enumerate(book):
        diff = x - entry
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry (of equally near ones the first), upper bound, and lower bound of the second nearest, by comparing all entries."""
    d = squared(x, book)
    code = d.argmin(axis=1)
    at = np.arange(len(x))
    upper = _up(np.sqrt(d[at, code].astype(np.float64)))
    if len(book) == 1:
        return code, upper, np.full(len(x), np.inf, dtype=np.float32)
    rest = d.astype(np.float64)
    rest[at, code] = np.inf
    return code, upper, _down(np.sqrt(rest.min(axis=1)))


@dataclass(frozen=True)
class Moved:
    """What one round needs of one part position: its codebook, how far entries have moved, and half the way to the next entry."""

    book: np.ndarray
    own: np.ndarray  # upper bounds of each entry's move
    others: np.ndarray  # of the farthest move of any other entry
    half: np.ndarray  # lower bounds

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray) -> Moved:
        own = _up(np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9))
        others = np.array([np.delete(own, j).max(initial=0) for j in range(len(own))], dtype=np.float32)
        apart = np.sqrt(squared(new, new).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        return Moved(new, own, others, _down(apart.min(axis=1) / 2))


def reassign(x: np.ndarray, moved: Moved, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry and bounds of one part after a move, and how many rows were compared with all entries."""
    code = code.astype(np.int64)
    upper = _up(upper.astype(np.float64) + moved.own[code])
    lower = _down(lower.astype(np.float64) - moved.others[code])
    bound = np.maximum(lower, moved.half[code])
    unsure = np.flatnonzero(~(upper < bound))
    diff = x[unsure] - moved.book[code[unsure]]
    upper[unsure] = _up(np.sqrt(np.einsum("ij,ij->i", diff, diff).astype(np.float64)))
    scan = unsure[~(upper[unsure] < bound[unsure])]
    if len(scan):
        code[scan], upper[scan], lower[scan] = nearest(x[scan], moved.book)
    return code, upper, lower, len(scan)


def _blob(rows: np.ndarray) -> pa.Array:
    """A binary column: the bytes of each row."""
    rows = np.ascontiguousarray(rows)
    width = rows[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _rows(column: pa.Array, kind) -> np.ndarray:
    """The inverse of ``_blob``, for a column without nulls."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(n, -1)


def scaled(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """Integer rows of a list column without nulls."""
    if not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError(f"not all vectors have {width} components")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(column), width)
    if (np.abs(x) >= LARGEST).any():
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return x.astype(np.int64)


def _fresh(clean: DataFrame, books: tuple, scale: int, kinds: dict) -> DataFrame:
    """The state after the first assignment, which compares everything."""
    parts, width = len(books), books[0].shape[1]

    def run(batches):
        sums = _Sums(books)
        for batch in filter(len, batches):
            x = scaled(batch.column("vector"), scale, parts * width).reshape(-1, parts, width)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            yield sums.add(batch, x, *(np.stack(c, axis=1) for c in zip(*found)))
        yield sums.batch(kinds)

    return clean.mapInArrow(run, _schema(kinds))


def _next(state: DataFrame, moved: list[Moved], kinds: dict) -> DataFrame:
    """The state after one more assignment."""
    parts, width = len(moved), moved[0].book.shape[1]

    def run(batches):
        sums = _Sums(tuple(m.book for m in moved))
        for batch in filter(len, batches):
            x = _rows(batch.column("x"), np.int32).astype(np.int64).reshape(-1, parts, width)
            old = [_rows(batch.column(c), k) for c, k in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))]
            found = [reassign(x[:, p], moved[p], *(c[:, p] for c in old))[:3] for p in range(parts)]
            yield sums.add(batch, x, *(np.stack(c, axis=1) for c in zip(*found)))
        yield sums.batch(kinds)

    return state.where("part IS NULL").mapInArrow(run, _schema(kinds))


def _final(state: DataFrame, moved: list[Moved], kinds: dict) -> DataFrame:
    """id, label, code and error after the last assignment."""
    parts, width = len(moved), moved[0].book.shape[1]

    def run(batches):
        for batch in filter(len, batches):
            x = _rows(batch.column("x"), np.int32).astype(np.int64).reshape(-1, parts, width)
            old = [_rows(batch.column(c), k) for c, k in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))]
            codes, error = np.empty((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                codes[:, p] = reassign(x[:, p], moved[p], *(c[:, p] for c in old))[0]
                diff = x[:, p] - moved[p].book[codes[:, p]]
                error += np.einsum("ij,ij->i", diff, diff)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _blob(codes), pa.array(error)], ["id", "label", "code", "error"])

    return state.where("part IS NULL").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")


def _schema(kinds: dict) -> str:
    return f"id {kinds['id']}, label {kinds['label']}, x binary, code binary, upper binary, lower binary, part int, entry int, n long, sums array<long>"


class _Sums:
    """What a task's parts add to each entry; they leave the task as rows beside the state."""

    def __init__(self, books: tuple):
        self.n = np.zeros((len(books), len(books[0])), dtype=np.int64)
        self.sums = np.zeros((*self.n.shape, books[0].shape[1]), dtype=np.int64)

    def add(self, batch: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
        """Count the batch's parts, and give back its rows of the state."""
        for p in range(x.shape[1]):
            self.n[p] += np.bincount(code[:, p], minlength=self.n.shape[1])
            for j in np.unique(code[:, p]):
                self.sums[p, j] += x[code[:, p] == j, p].sum(axis=0)
        k = batch.num_rows
        none = [pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
        own = [_blob(x.reshape(k, -1).astype(np.int32)), _blob(code.astype(np.uint8)), _blob(upper.astype(np.float32)), _blob(lower.astype(np.float32))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *own, *none], [*"id label x code upper lower part entry n sums".split()])

    def batch(self, kinds: dict) -> pa.RecordBatch:
        part, entry = np.nonzero(self.n)
        own = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(self.n[part, entry]), pa.array(list(self.sums[part, entry]), pa.list_(pa.int64()))]
        none = [pa.nulls(len(part), t) for t in (kinds["arrow_id"], kinds["arrow_label"], *[pa.binary()] * 4)]
        return pa.RecordBatch.from_arrays([*none, *own], [*"id label x code upper lower part entry n sums".split()])


def _updated(state: DataFrame, books: tuple) -> tuple:
    """Each entry the floored mean of its parts; entries without parts stay. The driver gets one number for each component of the codebooks."""
    rows = state.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    out = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    return tuple(out)


def cleaned(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and vector of the rows whose vector is usable: neither null nor empty, every component finite."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("vector"))


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """``id``, ``label``, ``code`` (a byte for each part) and ``error`` (summed squared distance) of every usable vector, and the codebooks.

    Null and empty vectors, and vectors with a null or non-finite component, are left out. Codebooks start from the
    smallest distinct ids (null ids last; of repeated ids, the least vector); fewer vectors make fewer entries.
    Repeated rows get equal codes. With no vector left there are no rows, and the codebooks are empty. Vectors of
    different lengths, lengths that ``parts`` does not divide, and components of LARGEST and more raise ValueError.
    Columns other than the three named are not read.

    Each pass reads one written state and writes the next: no shuffle but of the sums, which are one row for each
    task and entry. Two states exist at a time.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    if rounds < 1:
        raise ValueError("at least one round")
    clean = cleaned(vectors, id_col, vector_col, label_col)
    kinds = {c: clean.schema[c].dataType.simpleString() for c in ("id", "label")}
    from pyspark.sql.pandas.types import to_arrow_type

    kinds |= {f"arrow_{c}": to_arrow_type(clean.schema[c].dataType) for c in ("id", "label")}
    first = [r["id"] for r in clean.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    own = F.col("id").isin([i for i in first if i is not None]) | (F.col("id").isNull() if None in first else F.lit(False))
    seeds = {r["id"]: r["vector"] for r in clean.where(own).groupBy("id").agg(F.min("vector").alias("vector")).collect()} if first else {}
    if not seeds:
        return clean.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), Codebooks((), scale)
    width = len(seeds[first[0]])
    if width % parts:
        raise ValueError(f"{parts} equal parts of {width} components")
    start = scaled(pa.array([seeds[i] for i in first], pa.list_(pa.float64())), scale, width).reshape(len(first), parts, -1)
    books = tuple(np.ascontiguousarray(start[:, p]) for p in range(parts))
    with scratch() as keep:
        state = materialize(_fresh(clean, books, scale, kinds), "codes")
        for k in range(rounds):
            old, books = books, _updated(state, books)
            moved = [Moved.between(a, b) for a, b in zip(old, books)]
            step = _final if k == rounds - 1 else _next
            before, state = state, materialize(step(state, moved, kinds), "codes")
            forget(before)
        keep(state)
    return state, Codebooks(books, scale)


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` (with ``code``, a byte for each part) with ``vector``: the entries that the code names, joined and scaled back. A null code gives null."""

    def run(batches):
        for batch in batches:
            vectors = [None if c is None else np.concatenate([b[i] for b, i in zip(books.entries, c)]) / books.scale for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return coded.mapInArrow(run, StructType([*coded.schema.fields]).add("vector", ArrayType(DoubleType())))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: its error summed over equal labels, null labels together. Sums are written first, so that Spark can split the join of a hot label."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "other"), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("other"))).drop("other")


def op11_vector_codes(spark, sf_dir):
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"),
    )


def _sql() -> str:
    """The same by plain rounds that compare everything."""
    d = "CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT r, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
s AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry, min(e) AS e FROM v GROUP BY vec_id ORDER BY entry LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, entry, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] AS c FROM s, (SELECT unnest(range({PARTS})) AS part))"""
    for k in range(ROUNDS + 1):
        out += f""",
a{k} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, arg_min(entry, struct_pack(d := d, entry := entry)) AS entry, min(d) AS d FROM (SELECT r, part, x, entry, {d} AS d FROM p JOIN c{k} USING (part)) GROUP BY r, part)"""
        if k < ROUNDS:
            out += f""",
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT part, entry, list(f ORDER BY pos) AS m FROM (SELECT part, entry, pos, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS f FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY part, entry, pos) GROUP BY part, entry) USING (part, entry))"""
    return out + f""",
o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM v JOIN o USING (r)"""


SQL = _sql()
