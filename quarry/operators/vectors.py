"""Vector search by exact cosine, an offline embedder, and the semantic cache."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..config import CACHE, RETRIEVAL
from ..functions.text import short_hash

#: Queries and vectors that are multiplied at a time: their scores make 80 MB.
QUERY_ROWS, VECTOR_ROWS = 500, 20_000
#: Queries of a task are this many times as many; it takes them one after the other, so that each vector is copied to fewer tasks.
QUERY_TURNS = 8
#: Vectors that are too few to be worth a task of their own.
FEW_ROWS = 1000


def unit(column: pa.Array | pa.ChunkedArray | list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, zero for those without a direction or of another length, and the lengths that they had (zero for those)."""
    if not len(column):
        return np.zeros((0, width)), np.zeros(0)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    out, norm = np.zeros((len(column), width)), np.zeros(len(column))
    if width and fits.any():
        own = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        size = np.linalg.norm(own, axis=1)
        out[fits] = np.where(size[:, None] > 0, own / np.where(size > 0, size, 1.0)[:, None], 0.0)
        norm[fits] = np.nan_to_num(size, nan=0.0, posinf=np.inf)
    return out, norm


def ranked(scores: np.ndarray, place: np.ndarray, k: int, least=None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best scores of each row, best first; -inf is none, and so is what lies below ``least``. Ties go to the smaller ``place`` of a column."""
    n = min(k, scores.shape[1])
    low = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n] if n else np.zeros(len(scores))
    row, col = np.nonzero((scores >= (low if least is None else np.maximum(low, least))[:, None]) & (scores > -np.inf))
    order = np.lexsort((place[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < n
    return row[keep], col[keep]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero for null, for zero vectors and for vectors of different length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, by: str | None = None) -> DataFrame:
    """query_id, id, ``score`` (cosine to 6 places) and rank of the ``k`` best ``vectors`` (id, embedding) of each of ``queries`` (query_id, vector).

    With ``by``, a column of both, a query is compared only with vectors of an equal value (a query may have several
    rows). Queries and vectors of each value are dealt into blocks by their place, so that a hot value fills none; each task
    multiplies a block of one with a block of the other and passes on only the best k of each query, so what is
    shuffled next is k rows for each query and block of vectors. Ties go to the smaller id. A null vector and one of
    another length than the queries' is skipped; a null or zero query scores 0 with everything.
    """
    group = [F.col(by).alias("_by")] if by else [F.lit(0).alias("_by")]
    (asked, width), cores = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first(), queries.sparkSession.sparkContext.defaultParallelism
    q, v = queries.select(*group, "query_id", "vector"), vectors.where(F.size("embedding") == width).select(*group, "id", "embedding")
    n_blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / (QUERY_ROWS * QUERY_TURNS)))
    n_parts = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(n / VECTOR_ROWS, F.least(F.lit(cores), n / FEW_ROWS))))
    placed = [df.withColumn("_at", F.monotonically_increasing_id()) for df in (q, v)]
    if by:
        # Each value has blocks of its own: what is copied follows its own queries and vectors, not those of all values.
        n_q, n_v = q.groupBy(F.col("_by").alias("_own")).agg(F.count(F.lit(1)).alias("_q")), v.groupBy("_by").agg(F.count(F.lit(1)).alias("_v"))
        dealt = n_q.join(n_v, F.col("_own").eqNullSafe(F.col("_by"))).select("_own", n_blocks(F.col("_q")).alias("_blocks"), n_parts(F.col("_v")).alias("_parts"))
        placed = [df.join(dealt, F.col("_by").eqNullSafe(F.col("_own"))) for df in placed]
    else:
        placed = [df.withColumns({"_blocks": n_blocks(F.lit(asked)), "_parts": n_parts(F.lit(vectors.count()))}) for df in placed]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = placed[0].select("_by", F.pmod("_at", "_blocks").alias("_block"), every("_parts").alias("_part"), "query_id", "vector")
    v = placed[1].select("_by", every("_blocks").alias("_block"), F.pmod("_at", "_parts").alias("_part"), "id", "embedding")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        x, y = unit(a.column("vector"), width)[0], unit(b.column("embedding"), width)[0]
        place, rows, cols, found = np.arange(len(b)), [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for at in range(0, len(x) if len(b) else 0, QUERY_ROWS):
            scores = np.round(x[at : at + QUERY_ROWS] @ y.T, 6) + 0.0
            row, col = ranked(scores, place, k, min_score)
            rows.append(row + at), cols.append(col), found.append(scores[row, col])
        return pa.table({"query_id": a.column("query_id").take(pa.array(np.concatenate(rows))), "id": b.column("id").take(pa.array(np.concatenate(cols))), "score": pa.array(np.concatenate(found))})

    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
    keys = ("_by", "_block", "_part")
    out = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group, by position."""
    kind = vectors.schema[by].dataType.simpleString()

    def sums(batches):
        # What leaves a task is one row for each of its groups and positions, however many vectors it has; a full table of sums is passed on early.
        held: dict = {}
        for batch in batches:
            for key, v in zip(batch.column("id").to_pylist(), batch.column("embedding")):
                if v.is_valid:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    own = held.setdefault((key, len(x)), [0, np.zeros(len(x))])
                    own[0] += 1
                    own[1] += x
            if len(held) > 10_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], ids), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x for _, x in held.values()], pa.list_(pa.float64()))], ["id", "n", "x"])

    ids = to_arrow_type(vectors.schema[by].dataType)
    each = vectors.select(F.col(by).alias("id"), "embedding").mapInArrow(sums, f"id {kind}, n long, x array<double>")
    parts = each.select("id", "n", F.posexplode("x").alias("at", "x")).groupBy("id", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding"))


@lru_cache(maxsize=1 << 17)
def _hashed(term: str) -> tuple[int, float]:
    """The first 32 bits of a term's SHA-256, and a sign from the next four."""
    h = hashlib.sha256(term.encode()).digest()
    return int.from_bytes(h[:4], "big"), -1.0 if h[4] >> 4 & 1 else 1.0


def hash_embedding(terms: Column, dim: int = 64) -> Column:
    """A unit vector of signed counts of hashed terms; zero without terms, and for null. The offline stand-in for an embedding model.

    Each distinct term of a batch is hashed once, and each term of a text is looked at once.
    """

    def embed(terms: pa.Array) -> pa.Array:
        n = len(terms)
        coded = terms.flatten().dictionary_encode()
        own = [_hashed(t) for t in coded.dictionary.to_pylist()]
        place, sign = np.array([h % dim for h, _ in own], dtype=np.int64), np.array([x for _, x in own])
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        term = coded.indices.to_numpy(zero_copy_only=False)
        raw = np.bincount(row * dim + place[term], sign[term], n * dim).reshape(n, dim)
        norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array((raw / np.where(norm > 0, norm, 1.0)).ravel()))

    return F.arrow_udf(embed, "array<double>")(terms)


def embed_once(docs: DataFrame, embed) -> DataFrame:
    """``docs`` with ``embedding``: each distinct text (null is one) is embedded once (``embed``: Column to Column) and joined back by its hash."""
    keyed = docs.withColumn("_key", F.coalesce(F.sha2("text", 256), F.lit("")))
    once = keyed.groupBy("_key").agg(F.first("text").alias("text")).select("_key", embed(F.col("text")).alias("embedding"))
    return keyed.join(once, "_key", "left").drop("_key")


def cache_lookup(queries: DataFrame, cache: DataFrame, now: int, threshold: float = CACHE.threshold) -> DataFrame:
    """query_id, id and similarity of the live entry (id, embedding, expires_at) that is nearest to each query, if it is near enough. Ties go to the first id."""
    live = cache.where(F.col("expires_at") > now)
    return top_k(queries, live, 1).where(F.col("score") >= threshold).select("query_id", "id", F.col("score").alias("similarity"))


def cache_put(cache: DataFrame, entries: DataFrame, max_entries: int = CACHE.max_entries) -> DataFrame:
    """``cache`` (id, created_at, ...) with ``entries`` in place of those with the same id; only the newest ``max_entries`` stay."""
    both = cache.join(entries.select("id"), "id", "left_anti").unionByName(entries)
    return both.orderBy(F.desc("created_at"), F.desc("id")).limit(max_entries)


def cache_invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """``cache`` without the entries of these keys (query_hash)."""
    return cache.join(keys.select("query_hash").distinct(), "query_hash", "left_anti").select(*cache.columns)


def cache_clear(cache: DataFrame) -> DataFrame:
    """No entry at all; the columns stay."""
    return cache.where("false")


def cache_key(query: Column) -> Column:
    return short_hash(query)


def hits(queries: DataFrame, vectors: DataFrame, k: int = RETRIEVAL.vector_top_k) -> DataFrame:
    return top_k(queries, vectors, k, RETRIEVAL.min_score)
