"""Queries over text functions, files and deltas, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files, text
from ..sources import scan
from .common import FILES, QUESTIONS, files_of, literal, table, values

PATHS = [(i, p) for i, p in enumerate(
    "src/index.ts src/a.py Dockerfile README.md data/x.CSV data/x.csv img/logo.png lib/x.min.js node_modules/foo/index.js pkg/node_modules/a.js build/out.js "
    "conf/app.yaml main.tf notes weird. .env docs/guide.rst a/b/c.go x.dockerfile yarn.lock mod.pyc deep/dist/readme.md report.docx".split()
)]


def questions(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query"))
    return literal(spark, QUESTIONS, "query_id long, query string").unionByName(asked)


ASKED = f"q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM {values(QUESTIONS, 'query_id, query')} UNION ALL SELECT item_id + 1000, text FROM benchmark)"
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
NORMAL = STRIP(r"regexp_replace(lower(regexp_replace(" + STRIP("query") + r", '\s+', ' ', 'g')), '[^\w\s\-_.?]', ' ', 'g')")
NORMALIZED = f"{ASKED}, n AS (SELECT query_id, {NORMAL} AS normalized FROM q)"


def normalize_query(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", text.normalize_query(F.col("query")).alias("normalized"))


def rewrite_query(spark, sf_dir):
    return normalize_query(spark, sf_dir).select("query_id", text.rewrite_query(F.col("normalized")).alias("rewritten"))


def detect_intent(spark, sf_dir):
    return normalize_query(spark, sf_dir).select("query_id", text.detect_intent(F.col("normalized")).alias("intent"))


def intent_filters(spark, sf_dir):
    df = detect_intent(spark, sf_dir)
    return df.select("query_id", "intent", *[F.array_join(text.intent_filter(F.col("intent"), f), ",").alias(f) for f in ("tags", "domains", "kinds")])


def fts_sanitize(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(text.sanitize_fts(F.col("query")), "|").alias("terms"))


_MAP = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in text.SYNONYMS.items()) + "}"
_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(normalized), '{p}') THEN '{n}'" for n, p in text.INTENTS) + " ELSE 'general' END"
_NARROW = {f: "CASE intent " + " ".join(f"WHEN '{n}' THEN '{','.join(v)}'" for n, (g, v) in text.NARROWING.items() if g == f) + " END" for f in ("tags", "domains", "kinds")}


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_tokens(F.col("text"), 100).alias("cut"))


def scan_fingerprint(spark, sf_dir):
    raw = files_of(spark, sf_dir).select("relative_path", F.col("content").cast("binary").alias("content"), F.lit(0.0).alias("modified_time"))
    return scan.fingerprints(raw).drop("content", "modified_time")


def language_category(spark, sf_dir):
    path = F.col("path")
    df = literal(spark, PATHS, "n long, path string").withColumn("language", files.language_of(path)).withColumn("is_binary", files.is_binary_path(path))
    return df.select("n", "language", "is_binary", files.category_of(F.col("language")).alias("category"), files.mime_of(F.col("language"), F.col("is_binary")).alias("mime"), files.module_of(path).alias("module"))


def ignore_filter(spark, sf_dir):
    return literal(spark, PATHS, "n long, path string").where(~files.ignored(F.col("path"))).select("n", "path")


_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in files.LANGUAGE_OF.items()) + "}"
_CAT = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in files.CATEGORY_OF.items()) + "}"
_MIME = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in files.MIME.items()) + "}"
_BIN = ", ".join(f"'{x}'" for x in files.BINARY)


def _prints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), text.short_hash(F.col("text")).alias("hash"), F.col("n_chars").cast("double").alias("modified_time"), "doc_id")


def _previous(spark, sf_dir):
    """What was seen before: some documents are missing, some had another hash, some are gone."""
    old = _prints(spark, sf_dir).where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    gone = spark.range(50).select(F.concat(F.lit("gone/"), F.col("id")).alias("path"), F.lit("0").alias("hash"), F.lit(0.0).alias("modified_time"), F.lit(-1).cast("long").alias("doc_id"))
    return old.unionByName(gone)


def file_delta(spark, sf_dir):
    return scan.delta(_prints(spark, sf_dir), _previous(spark, sf_dir))


def delta_counts(spark, sf_dir):
    return file_delta(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_CUR = "cur AS (SELECT source || '/' || doc_id AS path, substr(sha256(text), 1, 16) AS hash, CAST(n_chars AS DOUBLE) AS mt, doc_id FROM documents)"
_PREV = "prev AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN reverse(hash) ELSE hash END AS hash, mt FROM cur WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || i, '0', 0 FROM range(50) r(i))"
_DELTA = f"WITH {_CUR}, {_PREV}, d AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.hash IS NULL THEN 'new' WHEN c.hash IS NULL THEN 'deleted' WHEN c.hash <> p.hash OR c.mt <> p.mt THEN 'modified' ELSE 'unchanged' END AS status FROM cur c FULL JOIN prev p ON c.path = p.path)"


def upsert_latest(spark, sf_dir):
    new = _prints(spark, sf_dir).where("doc_id % 3 = 0")
    return scan.upsert(_previous(spark, sf_dir), new, ["path"]).select("path", "hash")


def delete_by_document(spark, sf_dir):
    gone = file_delta(spark, sf_dir).where("status IN ('deleted', 'modified')")
    return scan.delete(_previous(spark, sf_dir), gone, ["path"]).select("path", "hash")


def storage_stats(spark, sf_dir):
    out = None
    for name in ("documents", "pages", "embeddings", "labels", "conversations"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def query_metrics(spark, sf_dir):
    """Totals of a log of runs: events as queries, with their value as milliseconds."""
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.col("value")).cast("long")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(ms).alias("total_ms"), text.format_duration(F.max(ms)).alias("slowest"),
        F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 4).alias("hit_rate"),
    )


QUERIES = {f.__name__: f for f in (
    normalize_query, rewrite_query, detect_intent, intent_filters, fts_sanitize, token_estimate, truncate_tokens, scan_fingerprint, language_category,
    ignore_filter, file_delta, delta_counts, upsert_latest, delete_by_document, storage_stats, query_metrics,
)}
_CLEAN = r"list_filter(string_split_regex(regexp_replace(query, '[''\x22*()]', '', 'g'), '\s+'), lambda x: length(x) > 1)"
ORACLE = {
    "normalize_query": f"WITH {NORMALIZED} SELECT * FROM n",
    "rewrite_query": rf"WITH {NORMALIZED}, w AS (SELECT query_id, string_split_regex(normalized, '\s+') AS w FROM n), x AS (SELECT query_id, list_concat(w, flatten(list_transform(w, lambda k: coalesce({_MAP}[k], [])))) AS l FROM w) SELECT query_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ' ') AS rewritten FROM x",
    "detect_intent": f"WITH {NORMALIZED} SELECT query_id, {_CASE} AS intent FROM n",
    "intent_filters": f"WITH {NORMALIZED}, i AS (SELECT query_id, {_CASE} AS intent FROM n) SELECT query_id, intent, {', '.join(f'{v} AS {k}' for k, v in _NARROW.items())} FROM i",
    "fts_sanitize": f"WITH {ASKED} SELECT query_id, array_to_string({_CLEAN}, '|') AS terms FROM q",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents",
    "truncate_tokens": "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS cut FROM documents",
    "scan_fingerprint": f"WITH {FILES} SELECT relative_path, 'text' AS language, false AS is_binary, 'documentation' AS category, substr(sha256(content), 1, 16) AS hash, CAST(strlen(content) AS BIGINT) AS size, 'utf-8' AS encoding, 'text/plain' AS mime_type FROM files WHERE NOT regexp_matches(content, '[\\x00-\\x07\\x0E-\\x1A\\x1C-\\x1F]')",
    "language_category": f"WITH p AS (SELECT n, path, string_split(path, '/')[-1] AS name FROM {values(PATHS, 'n, path')}), l AS (SELECT n, path, coalesce({_LANG}[name], {_LANG}['.' || string_split(name, '.')[-1]]) AS language, lower('.' || string_split(path, '.')[-1]) IN ({_BIN}) AS is_binary FROM p) SELECT CAST(n AS BIGINT) AS n, language, is_binary, coalesce({_CAT}[language], 'unknown') AS category, CASE WHEN is_binary THEN 'application/octet-stream' ELSE coalesce({_MIME}[language], 'text/plain') END AS mime, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] END AS module FROM l",
    "ignore_filter": rf"SELECT CAST(n AS BIGINT) AS n, path FROM {values(PATHS, 'n, path')} WHERE NOT regexp_matches(path, '(^|/)(node_modules|\.git|dist|build|bin|obj|coverage|\.cache|venv|__pycache__)/') AND NOT regexp_matches(path, '\.(pyc|pyo|class|o|a|so|dll|exe|bin|lock|map|min\.js|min\.css)$') AND NOT regexp_matches(path, '(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$')",
    "file_delta": f"{_DELTA} SELECT * FROM d",
    "delta_counts": f"{_DELTA} SELECT status, count(*) AS n FROM d GROUP BY status",
    "upsert_latest": f"WITH {_CUR}, {_PREV} SELECT path, hash FROM cur WHERE doc_id % 3 = 0 UNION ALL SELECT path, hash FROM prev WHERE path NOT IN (SELECT path FROM cur WHERE doc_id % 3 = 0)",
    "delete_by_document": f"{_DELTA} SELECT path, hash FROM prev WHERE path NOT IN (SELECT path FROM d WHERE status IN ('deleted', 'modified'))",
    "storage_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "embeddings", "labels", "conversations")),
    "query_metrics": "SELECT event_type, count(*) AS runs, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms, CASE WHEN max(floor(value)) < 1000 THEN CAST(CAST(max(floor(value)) AS BIGINT) AS VARCHAR) || 'ms' ELSE printf('%.1fs', max(floor(value)) / 1000) END AS slowest, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate FROM events GROUP BY event_type",
}
