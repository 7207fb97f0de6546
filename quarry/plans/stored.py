"""Queries over stored tables, model protocols, caches and walks with admission, and their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions.text import from_iso, iso_time
from ..operators import cells, fusion, graph, lexical, lookup, models, vectors
from ..streaming import debounce as feed
from .common import literal, store_of, table
from .lookups import CHUNK, _chunks
from .search import NOW, QUERY_TERMS, _asked, _cache, _fused, _H, _knn, _merged, _vectors
from .structure import TRADE, _trade
from .understanding import FILE, _summaries


def summaries_sink(spark, sf_dir):
    """File summaries in a store: written with stale purposes, then changed twice in one batch (the later row counts), one module deleted."""
    s = _summaries(spark, sf_dir).select("path", "purpose", "domain")
    stale = s.withColumn("purpose", F.lit("stale")).withColumn("at", F.lit(1))
    with store_of(spark) as (store, kept):
        store.commit(lambda c: c.upsert("summaries", stale, ["path"], "at"))
        store.commit(lambda c: c.upsert("summaries", stale.unionByName(s.withColumn("at", F.lit(2))), ["path"], "at"))
        store.commit(lambda c: c.delete("summaries", s.where(F.startswith("path", F.lit("src3/")))))
        store.vacuum()
        return kept(store.read("summaries").select("path", "purpose", "domain"))


def vectors_sink(spark, sf_dir):
    """Vectors in a store: all written negated, those of even ids written again with a repeated key, one label deleted, and those with an id divisible by 50 looked up."""
    v = _vectors(spark, sf_dir)
    wrong = v.withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("at", F.lit(1))
    right = v.where("id % 2 = 0").withColumn("at", F.lit(2))
    with store_of(spark) as (store, kept):
        store.commit(lambda c: c.upsert("vectors", wrong, ["id"], "at"))
        store.commit(lambda c: c.upsert("vectors", right.unionByName(wrong.where("id % 4 = 0")), ["id"], "at"))
        store.commit(lambda c: c.delete("vectors", v.where("label = 3").select("id")))
        found = store.lookup("vectors", v.where("id % 50 = 0 OR id % 50 = 1").select("id"))
        return kept(found.select("id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x), 4).alias("total")))


def graph_sink(spark, sf_dir):
    """Nodes and edges published together, edges by source, target and kind: each written twice, then those of one kind with other weights."""
    nodes, edges = _trade(spark, sf_dir)
    with store_of(spark) as (store, kept):

        def first(c):
            c.upsert("nodes", nodes.unionByName(nodes), ["id"])
            c.upsert("edges", edges.unionByName(edges).select("source_id", "target_id", "kind", "weight"), ["source_id", "target_id", "kind"])

        store.commit(first)
        heavier = edges.where("kind = 'depends_on'").select("source_id", "target_id", "kind", (F.col("weight") + 1).alias("weight"))
        store.commit(lambda c: c.upsert("edges", heavier, ["source_id", "target_id", "kind"]))
        n, e = store.read("nodes"), store.read("edges")
        return kept(e.join(n.select(F.col("id").alias("target_id"), F.col("kind").alias("target_kind")), "target_id", "left").groupBy("kind", "target_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight")))


def collection_status(spark, sf_dir):
    """The number of rows of each collection of a store, or "missing"."""
    with store_of(spark) as (store, _):
        store.commit(lambda c: (c.upsert("vectors", _vectors(spark, sf_dir), ["id"]), c.append("pages", table(spark, sf_dir, "pages").select("page_id", "url"))))
        found = store.status(["vectors", "pages", "summaries"])
    return literal(spark, [(n, "missing" if k is None else str(k)) for n, k in found.items()], "name string, status string")


def iso_stamps(spark, sf_dir):
    """Instants as text and back, and rows as JSON."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", iso_time(F.col("ts")).alias("stamp"))
    return e.select("event_id", "stamp", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "stamp")).alias("json"), F.unix_millis(from_iso(F.col("stamp"))).alias("ms"))


def metrics_append(spark, sf_dir):
    """A log of runs in two appends, each delivered twice; only the first delivery counts."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").cast("long").alias("ms"))
    with store_of(spark) as (store, kept):
        for k in (0, 0, 1, 0, 1):
            store.commit(lambda c: c.append("metrics", e.where(F.col("event_id") % 2 == k).withColumn("batch", F.lit(k))), "runs", k)
        return kept(store.read("metrics").groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("runs"), F.sum("ms").alias("ms")))


def applied_changes(spark, sf_dir):
    """Events as changes of users in three batches, one of them delivered again late: the table as the last event of each user leaves it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("kind"), "event_id", F.col("event_type").alias("value"))
    with store_of(spark) as (store, kept):
        write = feed.apply_to(store, "events", "users", ["key"], "event_id")
        total = e.count()
        for k, (a, b) in enumerate(((0, 0.3), (0.3, 0.8), (0.8, 2))):
            write(e.where((F.col("event_id") >= a * total) & (F.col("event_id") < b * total)), k)
        write(e.where(F.col("event_id") < 0.3 * total), 0)
        return kept(store.read("users").select("key", "event_id", "value"))


class Hashing:
    """A deterministic model in place of a served one: ``vectors.hash_embedding`` in Python. Each worker's first call and every seventh fails, to be tried again."""

    def __init__(self, dim: int):
        self.dim, self.calls = dim, 0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import re

        self.calls += 1
        if self.calls % 7 == 1:
            raise ConnectionError("planned")
        out = []
        for t in texts:
            own = [0.0] * self.dim
            for term in re.split(r"[\W_]+", t.lower()):
                if term:
                    h = hashlib.sha256(term.encode()).hexdigest()
                    own[int(h[:8], 16) % self.dim] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
            norm = sum(x * x for x in own) ** 0.5
            out.append([x / norm if norm else x for x in own])
        return out


def knn_cells(spark, sf_dir):
    """All stated queries against all vectors over stored cells; the same rows as comparing everything."""
    with store_of(spark) as (store, kept):
        number = itertools.count()

        def keep(df):
            name = f"step{next(number)}"
            store.commit(lambda c: c.append(name, df))
            return store.read(name)

        out, _ = cells.Cells(store).build(_vectors(spark, sf_dir)).search(_asked(spark, sf_dir), 20, keep=keep)
        return kept(out)


def model_embed(spark, sf_dir):
    """Benchmark texts through the embedder protocol: batches, planned failures, further attempts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    e = models.embedded(b, Hashing(16), rows=8, wait=0.0)
    return e.select("item_id", F.posexplode("embedding").alias("dim", "x")).select("item_id", "dim", F.round("x", 6).alias("x"))


def embed_cached(spark, sf_dir):
    """What each of three runs over a stored cache embeds: half of the documents, all of them, all of them again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    with store_of(spark) as (store, kept):
        cache = models.EmbeddingCache(store)
        for part in (d.where("doc_id % 2 = 0"), d, d):
            out = cache.embed(part, Hashing(8), wait=0.0)
        seen = cache.runs().select(F.col("run").cast("int").alias("run"), "entries")
        return kept(seen.unionByName(out.agg(F.lit(0).alias("run"), F.count("embedding").alias("entries"))))


def _words():
    return {i: " ".join(w) for i, w in QUERY_TERMS}


def shared_words(query: str, texts: list[str]) -> list[float]:
    """The stand-in reranker: the share of the query's words that a text contains."""
    words = query.split(" ")
    return [sum(w in t for w in words) / len(words) for t in texts]


def _candidates(spark, sf_dir):
    words = literal(spark, list(_words().items()), "n long, query string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    named = _merged(spark, sf_dir).withColumn("n", F.floor(F.col("query_id") / 50) % len(QUERY_TERMS)).join(words, "n")
    return named.join(docs, "id", "left").select("query_id", "query", "id", "text", "score")


def rerank_hybrid(spark, sf_dir):
    """The fused result of every stated query, reranked by a batched model."""
    return models.reranked(_candidates(spark, sf_dir), shared_words, wait=0.0).select("query_id", "rank", "id", "rerank_score", "score")


def rerank_unavailable(spark, sf_dir):
    """The same with a model that does not answer: the fused order stays."""
    return models.reranked(_candidates(spark, sf_dir), shared_words, available=lambda: False).select("query_id", "rank", "id", "score")


def hybrid_content(spark, sf_dir):
    """The fused result with what a caller shows: path, lines and content of each hit."""
    best = fusion.rerank(fusion.ranked(_merged(spark, sf_dir), RETRIEVAL.candidates), RETRIEVAL.final_top_k)
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("relative_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    out = lookup.with_content(best, chunks, d.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return out.select("query_id", "rank", "id", "score", "relative_path", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("md5"))


def fixed_batches_stream(spark, sf_dir):
    """Chunks in batches of 32 by their place in the whole stream."""
    out = lookup.stream_batches(_chunks(spark, sf_dir).select("document_id", "idx"), 32, ["document_id", "idx"])
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("document_id", "idx")).alias("first")).select("batch", "n", F.col("first.document_id").alias("document_id"), F.col("first.idx").alias("idx"))


def cache_invalidated(spark, sf_dir):
    c = _cache(spark, sf_dir).withColumn("query_hash", vectors.cache_key(F.col("id").cast("string"))).select("id", "query_hash", "expires_at")
    return vectors.cache_invalidate(c, c.where("id % 5 = 0").select("query_hash"))


def cache_cleared(spark, sf_dir):
    c = _cache(spark, sf_dir).select("id", "expires_at")
    return vectors.cache_clear(c).agg(F.count(F.lit(1)).alias("kept")).join(c.agg(F.count(F.lit(1)).alias("before")), how="cross")  # one row each


def expand_nodes(spark, sf_dir):
    """A walk that admits fifteen nodes, some of them in the middle of a level."""
    nodes, edges = _trade(spark, sf_dir)
    return graph.expand(nodes, edges, literal(spark, [("r1",), ("c1",)], "id string"), 2, max_nodes=15)[0]


def expand_edges(spark, sf_dir):
    """The edges that this walk records, those to nodes that it no longer admits too."""
    nodes, edges = _trade(spark, sf_dir)
    return graph.expand(nodes, edges, literal(spark, [("r1",), ("c1",)], "id string"), 2, max_nodes=15)[1].select("id", "source_id", "target_id", "kind")


def edges_out(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    return graph.edges_at(edges, literal(spark, [("n1",), ("p3",), ("r2",)], "id string"), "source_id", ["contains", "depends_on"]).select("id", "source_id", "target_id")


def project_summaries(spark, sf_dir):
    """The stored summaries of one project."""
    s = _summaries(spark, sf_dir).withColumn("project_id", F.substring_index("path", "/", 1))
    return lookup.project_of(s, "src2").select("path", "purpose")


QUERIES = {f.__name__: f for f in (
    summaries_sink, vectors_sink, graph_sink, collection_status, iso_stamps, metrics_append, applied_changes, knn_cells, model_embed, embed_cached, rerank_hybrid, rerank_unavailable, hybrid_content,
    fixed_batches_stream, cache_invalidated, cache_cleared, expand_nodes, expand_edges, edges_out, project_summaries,
)}

_QUERY = "(VALUES " + ", ".join(f"({i}, '{w}')" for i, w in _words().items()) + ") AS t(i, w)"
_EDGE = "'edge_' || substr(sha256(s || ':' || t || ':' || k), 1, 16)"
#: Levels of a walk from r1 and c1: the first fifteen by level and id are admitted, and what is admitted above the last level is walked from.
_WALK = f"""{TRADE}, bo AS (SELECT s AS u, t AS v FROM ed UNION SELECT t, s FROM ed),
l0 AS (SELECT id, 0 AS depth FROM (VALUES ('r1'), ('c1')) AS x(id)), l1 AS (SELECT DISTINCT v AS id, 1 AS depth FROM l0 JOIN bo ON u = id WHERE v NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT v AS id, 2 AS depth FROM l1 JOIN bo ON u = id WHERE v NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1)),
al AS (SELECT *, id IN (SELECT id FROM no) AS real FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)),
ok AS (SELECT *, coalesce(sum(CAST(real AS INT)) OVER (ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 15 AS walked FROM al)"""
ORACLE = {
    "summaries_sink": f"WITH {FILE} SELECT path, purpose, domain FROM fs WHERE NOT starts_with(path, 'src3/')",
    "vectors_sink": "SELECT vec_id AS id, label, round(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END * list_sum(CAST(embedding AS DOUBLE[])), 4) + 0 AS total FROM embeddings WHERE vec_id % 50 IN (0, 1) AND label <> 3",
    "graph_sink": f"WITH {TRADE}, nk AS (SELECT id, CASE id[1] WHEN 'r' THEN 'region' WHEN 'n' THEN 'nation' WHEN 'c' THEN 'customer' ELSE 'supplier' END AS target_kind FROM no) SELECT k AS kind, target_kind, count(*) AS n, round(sum(CASE WHEN k = 'contains' THEN 1::DOUBLE ELSE 1.8::DOUBLE END), 3) AS weight FROM ed LEFT JOIN nk ON id = t GROUP BY ALL",
    "collection_status": "SELECT 'vectors' AS name, CAST(count(*) AS VARCHAR) AS status FROM embeddings UNION ALL SELECT 'pages', CAST(count(*) AS VARCHAR) FROM pages UNION ALL SELECT 'summaries', 'missing'",
    "iso_stamps": """SELECT event_id, stamp, '{"id":' || event_id || ',"type":"' || event_type || '","stamp":"' || stamp || '"}' AS json, epoch_us(ts) // 1000 AS ms FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM events)""",
    "metrics_append": "SELECT event_type, CAST(event_id % 2 AS INT) AS batch, count(*) AS runs, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY ALL",
    "applied_changes": "SELECT user_id AS key, event_id, event_type AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'",
    "knn_cells": f"WITH {_knn(20)} SELECT * FROM r",
    "model_embed": f"WITH {_H(16, ('text', 'benchmark'), 'item_id')}, a AS (SELECT item_id, unnest(range(16)) AS dim FROM benchmark) SELECT item_id, CAST(a.dim AS INT) AS dim, round(coalesce(x / n, 0), 6) AS x FROM a LEFT JOIN raw USING (item_id, dim) LEFT JOIN n USING (item_id)",
    "embed_cached": "SELECT 1 AS run, count(DISTINCT text) AS entries FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 2, count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) HAVING count(*) > 0 UNION ALL SELECT 0, count(*) FROM documents",
    "rerank_hybrid": f"WITH {_fused('1 - {}')}, c AS (SELECT query_id, id, b.score, list_sum(list_transform(string_split(w, ' '), lambda x: CAST(contains(text, x) AS INT))) / len(string_split(w, ' ')) AS rr FROM b JOIN {_QUERY} ON i = (query_id // 50) % {len(QUERY_TERMS)} JOIN documents ON doc_id = id WHERE rank <= 50) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rr, 6) DESC, score DESC, id) AS INT) AS rank, id, CAST(round(rr, 6) AS DOUBLE) AS rerank_score, score FROM c QUALIFY rank <= 10",
    "rerank_unavailable": f"WITH {_fused('1 - {}')} SELECT query_id, rank, id, score FROM b WHERE rank <= 10",
    "hybrid_content": f"WITH {_fused('1 - {}')} SELECT query_id, rank, id, b.score, source || '/' || doc_id || '.txt' AS relative_path, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INT) AS end_line, md5(text) AS md5 FROM b JOIN documents ON doc_id = id WHERE rank <= 10",
    "fixed_batches_stream": f"WITH {CHUNK}, p AS (SELECT document_id, idx, (row_number() OVER (ORDER BY document_id, idx) - 1) // 32 AS batch FROM ck) SELECT batch, count(*) AS n, arg_min(document_id, (document_id, idx)) AS document_id, arg_min(idx, (document_id, idx)) AS idx FROM p GROUP BY batch",
    "cache_invalidated": f"SELECT vec_id AS id, substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16) AS query_hash, {NOW} - vec_id * 37 % 7200 + 3600 AS expires_at FROM embeddings WHERE vec_id % 5 > 0",
    "cache_cleared": "SELECT CAST(0 AS BIGINT) AS kept, count(*) AS before FROM embeddings",
    "expand_nodes": f"WITH {_WALK} SELECT id, depth FROM ok WHERE real AND walked",
    "expand_edges": f"WITH {_WALK} SELECT {_EDGE} AS id, s AS source_id, t AS target_id, k AS kind FROM ed WHERE s IN (SELECT id FROM ok WHERE walked AND depth < 2) OR t IN (SELECT id FROM ok WHERE walked AND depth < 2)",
    "edges_out": f"WITH {TRADE} SELECT {_EDGE} AS id, s AS source_id, t AS target_id FROM ed WHERE s IN ('n1', 'p3', 'r2')",
    "project_summaries": f"WITH {FILE} SELECT path, purpose FROM fs WHERE starts_with(path, 'src2/')",
}
