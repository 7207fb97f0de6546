"""Queries over vectors, fused retrieval and the semantic cache, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CACHE, RETRIEVAL
from ..functions.text import estimate_tokens
from ..operators import fusion, lexical, vectors
from .common import literal, store_of, table
from .retrieval import INDEX, SCORE, TERMS, searched


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark, sf_dir):
    """The stated queries: every row whose id is divisible by 50."""
    return _vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def cosine_topk(spark, sf_dir):
    """One query: the least id."""
    one = _asked(spark, sf_dir).orderBy("query_id").limit(1)
    return vectors.top_k(one, _vectors(spark, sf_dir), 20).select("id", "score", "rank")


def knn_multi_query(spark, sf_dir):
    return vectors.top_k(_asked(spark, sf_dir), _vectors(spark, sf_dir), 20)


def cosine_threshold_filtered(spark, sf_dir):
    return vectors.hits(_asked(spark, sf_dir), _vectors(spark, sf_dir).where("label % 2 = 0"))


def module_centroid_search(spark, sf_dir):
    return vectors.top_k(_asked(spark, sf_dir), vectors.centroids(_vectors(spark, sf_dir), "label"), 3)


def file_vector_search(spark, sf_dir):
    """Documents by their vector: the file level of the hierarchy, ten for each query."""
    files = _vectors(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return vectors.top_k(_asked(spark, sf_dir), files, 10)


def hash_embed(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.posexplode(vectors.hash_embedding(lexical.terms_of(F.col("text")), 16)).alias("dim", "x")).select("item_id", "dim", F.round("x", 6).alias("x"))


def embed_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = vectors.embed_once(d, lambda c: vectors.hash_embedding(lexical.terms_of(c), 8))
    return e.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"))


QUERY_TERMS = [(i, w.split()) for i, w in enumerate(("the and", "with of", "est la", "und der", "que de", "that this", "not was", "are he", "en para", "die zu"))]


def _lexical(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = literal(spark, QUERY_TERMS, "n long, terms array<string>")
    asked = _asked(spark, sf_dir).withColumn("n", F.floor(F.col("query_id") / 50) % len(QUERY_TERMS)).join(words, "n").select("query_id", "terms")
    return searched(spark, docs, asked, k)


def _graph_hits(spark, sf_dir, found, text):
    """Candidates of the same source as one of the best five vector hits: only candidates are joined, whatever a source holds."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    seeds = found.where("rank <= 5").join(docs, "id").select("query_id", "source").distinct()
    both = found.select("query_id", "id").unionByName(text.select("query_id", "id")).distinct()
    return both.join(docs, "id").join(seeds, ["query_id", "source"], "left_semi").select("query_id", "id")


def _merged(spark, sf_dir, fixed=False):
    with store_of(spark) as (_, kept):  # the best vectors are read three times, and found once
        found = kept(vectors.top_k(_asked(spark, sf_dir), _vectors(spark, sf_dir), RETRIEVAL.vector_top_k))
    text = _lexical(spark, sf_dir, RETRIEVAL.fts_top_k)
    return fusion.merge(found.where(F.col("score") >= RETRIEVAL.min_score), text, _graph_hits(spark, sf_dir, found, text), fixed)


def _scores(df):
    return df.select("query_id", "id", F.round("vector_score", 6).alias("vector_score"), F.round("fts_score", 6).alias("fts_score"), "graph_score", "score")


def hybrid_merge(spark, sf_dir):
    return _scores(_merged(spark, sf_dir))


def hybrid_topk(spark, sf_dir):
    """The flagship: vector and full-text search fused, the best ten of fifty candidates of each query, with their tokens."""
    best = fusion.rerank(fusion.ranked(_merged(spark, sf_dir), RETRIEVAL.candidates), RETRIEVAL.final_top_k)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), estimate_tokens(F.col("text")).alias("tokens"))
    return best.join(docs, "id", "left").select("query_id", "rank", "id", "score", "tokens")


def hybrid_fixed(spark, sf_dir):
    return fusion.ranked(_merged(spark, sf_dir, fixed=True), RETRIEVAL.final_top_k).select("query_id", "rank", "id", "score")


def rerank_fallback(spark, sf_dir):
    return fusion.rerank(fusion.ranked(_merged(spark, sf_dir), RETRIEVAL.candidates), 5).select("query_id", "rank", "id", "score")


def _leveled(spark, sf_dir):
    """Vectors as chunks with a module (label) and a file (sixteen to a module)."""
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "module")
    return v.withColumn("file", F.concat_ws("/", "module", (F.col("id") % 16).cast("string")))


def hierarchical_retrieve(spark, sf_dir):
    """Modules, then files of these modules, then chunks of these files, for each query."""
    return fusion.hierarchical(_asked(spark, sf_dir), _leveled(spark, sf_dir))


def hierarchical_flat(spark, sf_dir):
    """The same with the levels switched off."""
    return fusion.hierarchical(_asked(spark, sf_dir), _leveled(spark, sf_dir), levels=())


NOW = 1_700_000_000


def _cache(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    made = F.lit(NOW) - (F.col("id") * 37 % 7200)
    return v.select("id", "embedding", made.alias("created_at"), (made + CACHE.ttl_seconds).alias("expires_at"))


def semantic_cache_lookup(spark, sf_dir):
    return vectors.cache_lookup(_asked(spark, sf_dir), _cache(spark, sf_dir), NOW)


def cache_ttl_filter(spark, sf_dir):
    return _cache(spark, sf_dir).where(F.col("expires_at") > NOW).select("id", "expires_at")


def cache_evict(spark, sf_dir):
    fresh = _vectors(spark, sf_dir).where("id % 50 = 0").select("id", "embedding", F.lit(NOW).cast("long").alias("created_at"), F.lit(NOW + 3600).cast("long").alias("expires_at"))
    return vectors.cache_put(_cache(spark, sf_dir), fresh, 100).select("id", "created_at")


def cache_hit_rate(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    hit = semantic_cache_lookup(spark, sf_dir).select("query_id", F.lit(1.0).alias("hit"))
    return asked.join(hit, "query_id", "left").agg(F.count(F.lit(1)).alias("lookups"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)), 4).alias("hit_rate"))


QUERIES = {f.__name__: f for f in (
    cosine_topk, knn_multi_query, cosine_threshold_filtered, module_centroid_search, file_vector_search, hash_embed, embed_dedup, hybrid_merge, hybrid_topk,
    hybrid_fixed, rerank_fallback, hierarchical_retrieve, hierarchical_flat, semantic_cache_lookup, cache_ttl_filter, cache_evict, cache_hit_rate,
)}

_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def _knn(k, asked="id % 50 = 0", pool="true", extra=""):
    return f"{_V}, s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) + 0 AS score FROM v q JOIN v ON true WHERE q.{asked} AND {pool}{extra}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= {k})"


_ASK = "ask AS (SELECT id AS query_id, unnest(string_split(w, ' ')) AS asked FROM v JOIN (VALUES " + ", ".join(f"({i}, '{' '.join(w)}')" for i, w in QUERY_TERMS) + f") AS t(i, w) ON i = (id // 50) % {len(QUERY_TERMS)} WHERE id % 50 = 0)"
_HIT = "hit AS (SELECT query_id, asked, id, tf FROM ask JOIN post ON asked = term)"
_CENT = "c AS (SELECT label AS id, list(x ORDER BY dim) AS e FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS dim FROM v) GROUP BY ALL) GROUP BY label), cs AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q JOIN c ON true WHERE q.id % 50 = 0), cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM cs QUALIFY rank <= 3)"


def _level(name, inside, k, out):
    """The best k groups (or chunks) of each query by their mean vector, inside what the level above found."""
    mean = "SELECT g, list(x ORDER BY dim) AS e FROM (SELECT {0} AS g, dim, avg(x) AS x FROM (SELECT *, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS dim FROM lv) GROUP BY ALL) GROUP BY g".format(name)
    return f"{out}m AS ({mean}), {out}s AS (SELECT q.id AS query_id, g, round(list_cosine_similarity(q.e, m.e), 6) + 0 AS score FROM lv q JOIN {out}m m ON true WHERE q.id % 50 = 0 AND {inside}), {out} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, g) AS INT) AS rank FROM {out}s QUALIFY rank <= {k})"


_LEVELS = f"""{_V}, lv AS (SELECT id, e, label AS module, label || '/' || id % 16 AS file FROM v), {_level('module', 'true', 3, 'lm')},
{_level('file', "(q.id, CAST(string_split(m.g, '/')[1] AS INT)) IN (SELECT (query_id, g) FROM lm)", 10, 'lf')},
ls AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.e, c.e), 6) + 0 AS score FROM lv q JOIN lf ON lf.query_id = q.id JOIN lv c ON c.file = lf.g WHERE q.id % 50 = 0),
lc AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM ls QUALIFY rank <= 10)"""


def _fused(share):
    return f"""{_knn(20, extra=" AND list_cosine_similarity(q.e, v.e) >= 0.2999995")}, {INDEX}, {_ASK}, {_HIT}, {SCORE},
seed AS (SELECT DISTINCT query_id, source FROM (SELECT q.id AS query_id, v.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.id) AS k FROM v q JOIN v ON true WHERE q.id % 50 = 0) x JOIN documents ON doc_id = x.id WHERE k <= 5),
g AS (SELECT query_id, doc_id AS id FROM documents JOIN seed USING (source)),
f AS (SELECT query_id, id, {share.format('abs(score) / greatest(max(abs(score)) OVER (PARTITION BY query_id), 1)')} AS fs FROM top),
m AS (SELECT query_id, id, coalesce(r.score, 0) AS vector_score, coalesce(fs, 0) AS fts_score, CASE WHEN (query_id, id) IN (SELECT (query_id, id) FROM g) THEN 0.1::DOUBLE ELSE 0 END AS graph_score FROM r FULL JOIN f USING (query_id, id)),
h AS (SELECT *, round(0.6 * vector_score + 0.3 * fts_score + 0.1::DOUBLE * graph_score, 6) AS score FROM m),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM h)"""


_CACHE = f"ch AS (SELECT id, e, {NOW} - id * 37 % 7200 AS created_at, {NOW} - id * 37 % 7200 + 3600 AS expires_at FROM v)"
_LOOK = f"{_V}, {_CACHE}, lk AS (SELECT q.id AS query_id, ch.id, round(list_cosine_similarity(q.e, ch.e), 6) AS similarity FROM v q JOIN ch ON expires_at > {NOW} WHERE q.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY similarity DESC, ch.id) = 1), ok AS (SELECT * FROM lk WHERE similarity >= 0.92)"
_H = lambda dim, src, key: f"h AS (SELECT {key}, CAST(('0x' || substr(sha256(t), 1, 8)) AS BIGINT) % {dim} AS dim, CASE WHEN CAST(('0x' || substr(sha256(t), 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT {key}, unnest({TERMS.format(src[0])}) AS t FROM {src[1]})), raw AS (SELECT {key}, dim, CAST(sum(sign) AS DOUBLE) AS x FROM h GROUP BY ALL), n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM raw GROUP BY {key})"
ORACLE = {
    "cosine_topk": f"WITH {_knn(20, 'id = (SELECT min(id) FROM v WHERE id % 50 = 0)')} SELECT id, score, rank FROM r",
    "knn_multi_query": f"WITH {_knn(20)} SELECT * FROM r",
    "cosine_threshold_filtered": f"WITH {_knn(20, extra=' AND v.label % 2 = 0')} SELECT * FROM r WHERE score >= 0.3",
    "module_centroid_search": f"WITH {_V}, {_CENT} SELECT query_id, CAST(id AS BIGINT) AS id, score, rank FROM cr",
    "file_vector_search": f"WITH {_knn(10, pool='v.id IN (SELECT doc_id FROM documents)')} SELECT * FROM r",
    "hash_embed": f"WITH {_H(16, ('text', 'benchmark'), 'item_id')}, a AS (SELECT item_id, unnest(range(16)) AS dim FROM benchmark) SELECT item_id, CAST(a.dim AS INT) AS dim, round(coalesce(x / n, 0), 6) AS x FROM a LEFT JOIN raw USING (item_id, dim) LEFT JOIN n USING (item_id)",
    "embed_dedup": f"WITH {_H(8, ('text', 'documents'), 'doc_id')}, s AS (SELECT doc_id, sum(x) AS s FROM raw GROUP BY doc_id) SELECT doc_id, round(coalesce(CASE WHEN n > 0 THEN s / n END, 0), 6) AS total FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)",
    "hybrid_merge": f"WITH {_fused('1 - {}')} SELECT query_id, id, round(vector_score, 6) AS vector_score, round(fts_score, 6) AS fts_score, graph_score, score FROM h",
    "hybrid_topk": f"WITH {_fused('1 - {}')} SELECT query_id, rank, id, score, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM b LEFT JOIN documents ON doc_id = id WHERE rank <= 10",
    "hybrid_fixed": f"WITH {_fused('{}')} SELECT query_id, rank, id, score FROM b WHERE rank <= 10",
    "rerank_fallback": f"WITH {_fused('1 - {}')} SELECT query_id, rank, id, score FROM b WHERE rank <= 5",
    "hierarchical_retrieve": f"WITH {_LEVELS} SELECT query_id, id, score, rank FROM lc",
    "hierarchical_flat": f"WITH {_knn(10)} SELECT * FROM r",
    "semantic_cache_lookup": f"WITH {_LOOK} SELECT * FROM ok",
    "cache_ttl_filter": f"WITH {_V}, {_CACHE} SELECT id, expires_at FROM ch WHERE expires_at > {NOW}",
    "cache_evict": f"WITH {_V}, {_CACHE} SELECT id, created_at FROM (SELECT id, created_at FROM ch WHERE id % 50 <> 0 UNION ALL SELECT id, {NOW} FROM v WHERE id % 50 = 0) ORDER BY created_at DESC, id DESC LIMIT 100",
    "cache_hit_rate": f"WITH {_LOOK} SELECT count(*) AS lookups, round(coalesce(avg(CASE WHEN ok.id IS NULL THEN 0.0 ELSE 1.0 END), 0), 4) AS hit_rate FROM v LEFT JOIN ok ON ok.query_id = v.id WHERE v.id % 50 = 0",
}
