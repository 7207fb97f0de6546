"""Queries over enrichment, summaries, compression and context packages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RETRIEVAL
from ..functions import rules
from ..functions.text import estimate_tokens
from ..operators import chunking, compress, enrich
from .common import literal, spread, table, values
from .fixtures import CODE
from .retrieval import WALK

BUDGET = 8000


def _chunks(spark, sf_dir):
    """Code fixtures, and each document as a chunk."""
    docs = spread(table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1000).alias("id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.lit("fallback").alias("kind"), F.lit("text").alias("language"),
        F.concat(F.lit("lines "), "doc_id").alias("title"), F.col("text").alias("content"),
    ))
    return literal(spark, CODE, "id long, path string, kind string, language string, title string, content string").unionByName(docs)


CHUNKS = f"""ch AS (SELECT CAST(id AS BIGINT) AS id, path, kind, language, title, content FROM {values(CODE, 'id, path, kind, language, title, content')} UNION ALL
SELECT doc_id + 1000, source || '/' || doc_id || '.txt', 'fallback', 'text', 'lines ' || doc_id, text FROM documents),
lo AS (SELECT id, kind, language, path AS raw_path, content AS raw, lower(path) AS path, lower(title) AS title, lower(content) AS content FROM ch)"""


def _joined(c):
    return F.array_join(c, ",")


def enrich_domain(spark, sf_dir):
    return enrich.enriched(_chunks(spark, sf_dir)).select("id", "domain")


def enrich_complexity(spark, sf_dir):
    return enrich.enriched(_chunks(spark, sf_dir)).select("id", "complexity")


def enrich_tags(spark, sf_dir):
    return enrich.enriched(_chunks(spark, sf_dir)).select("id", _joined("tags").alias("tags"))


def enrich_patterns(spark, sf_dir):
    return enrich.enriched(_chunks(spark, sf_dir)).select("id", _joined("patterns").alias("patterns"))


def side_effects(spark, sf_dir):
    return enrich.enriched(_chunks(spark, sf_dir)).select("id", _joined("side_effects").alias("side_effects"))


def public_api_flags(spark, sf_dir):
    return enrich.enriched(_chunks(spark, sf_dir)).select("id", "is_public_api", "is_entry_point")


def responsibilities(spark, sf_dir):
    return enrich.chunk_summary(_chunks(spark, sf_dir)).select("id", _joined("responsibilities").alias("responsibilities"), _joined("side_effects").alias("side_effects"))


def signature_info(spark, sf_dir):
    return enrich.chunk_summary(_chunks(spark, sf_dir)).select("id", _joined("inputs").alias("inputs"), _joined("outputs").alias("outputs"))


def chunk_summary(spark, sf_dir):
    return enrich.chunk_summary(_chunks(spark, sf_dir)).select("id", "summary")


def _files(spark, sf_dir):
    none = "array<struct<name:string,kind:string>>"
    return _chunks(spark, sf_dir).select("path", "language", F.when(F.col("id") > 1000, "unknown").otherwise("code").alias("type"), "content", F.array().cast(none).alias("symbols"), F.array(F.substring_index("path", "/", 1)).alias("dependencies"))


def _summaries(spark, sf_dir):
    return enrich.file_summary(_files(spark, sf_dir)).withColumn("module", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("_root"))


def file_summary(spark, sf_dir):
    return _summaries(spark, sf_dir).select("path", "summary", "purpose", "domain", _joined("tags").alias("tags"))


def module_summary(spark, sf_dir):
    return enrich.module_summary(_summaries(spark, sf_dir)).select("module", "files", "purpose", "domain", _joined("dependencies").alias("dependencies"), _joined("tags").alias("tags"), "summary")


def frameworks_detect(spark, sf_dir):
    return enrich.project_flags(_files(spark, sf_dir)).select(_joined("frameworks").alias("frameworks"), _joined("patterns").alias("patterns"), "purpose")


def project_languages(spark, sf_dir):
    return _files(spark, sf_dir).where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(5)


def project_summary(spark, sf_dir):
    return enrich.project_summary("corpus", _files(spark, sf_dir), enrich.module_summary(_summaries(spark, sf_dir))).select("files", "modules", _joined("entry_points").alias("entry_points"), "purpose", "summary")


def compress_code(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", compress.compress_code(F.col("content")).alias("compressed"))


def compress_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", compress.compress_text(F.col("content")).alias("compressed"))


def compress_chunk(spark, sf_dir):
    out = _chunks(spark, sf_dir).select("id", F.col("content"), compress.compress(F.col("content"), F.col("language")).alias("compressed"))
    return out.select("id", "compressed", estimate_tokens(F.col("content")).alias("before"), estimate_tokens(F.col("compressed")).alias("after"))


def compression_totals(spark, sf_dir):
    return compress_chunk(spark, sf_dir).agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum(F.col("before") - F.col("after")).alias("saved"))


def _ranked(spark, sf_dir):
    """As many chunks of each source as retrieval keeps candidates, longest first, as if a query had ranked them."""
    d = table(spark, sf_dir, "documents")
    c = chunking.line_blocks(d.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")))
    c = c.join(d.select(F.col("doc_id").alias("document_id"), "source"), "document_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("tokens"), "document_id", "end_line"))
    c = c.select(F.col("source").alias("query_id"), rank.alias("rank"), F.concat_ws(":", "document_id", "end_line").alias("id"), F.col("content").alias("body"), "start_line", "end_line", F.concat("source", F.lit("/"), "document_id").alias("path"), "tokens", "title")
    return c.where(F.col("rank") <= RETRIEVAL.candidates).withColumn("score", 1 / (F.col("rank") + 1.0))


def token_budget_context(spark, sf_dir):
    return compress.within_budget(_ranked(spark, sf_dir), BUDGET).select("query_id", "rank", "id", "used")


def assemble_context(spark, sf_dir):
    return compress.assemble(_ranked(spark, sf_dir), BUDGET)


def context_package(spark, sf_dir):
    return compress.package(_ranked(spark, sf_dir), BUDGET).select("query_id", F.array_join("ids", ",").alias("ids"), F.col("kept").cast("long").alias("kept"), "tokens", "truncated", "omitted")


def context_toggles(spark, sf_dir):
    """The package with relations switched on and summaries off."""
    r = _ranked(spark, sf_dir)
    rel = r.where(F.col("rank") <= 3).select("query_id", F.col("path").alias("source_id"), F.lit("contains").alias("kind"), F.col("title").alias("target_id"))
    return compress.package(r, BUDGET, relations=rel).select("query_id", F.col("kept").cast("long").alias("kept"), F.array_join("relations", "|").alias("relations"))


def serialize_context(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.concat(F.lit("about "), "source").alias("query")).distinct()
    r = _ranked(spark, sf_dir).where(F.col("rank") <= 3)
    rel = r.select("query_id", F.col("path").alias("source_id"), F.lit("contains").alias("kind"), F.col("title").alias("target_id"))
    return compress.serialize(q, r, rel)


QUERIES = {f.__name__: f for f in (
    enrich_domain, enrich_complexity, enrich_tags, enrich_patterns, side_effects, public_api_flags, responsibilities, signature_info, chunk_summary, file_summary,
    module_summary, frameworks_detect, project_languages, project_summary, compress_code, compress_text, compress_chunk, compression_totals,
    token_budget_context, assemble_context, context_package, context_toggles, serialize_context,
)}

_S = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_Q = lambda ps: "|".join(ps).replace("'", "''")
_one = lambda x: f"array_to_string({x}, ',')"
_DOM, _ROLE = rules.duck(rules.first_of(rules.FILE_DOMAIN, "unknown")), rules.duck(rules.first_of(rules.FILE_ROLE, "General purpose module"))
FILE = f"""{CHUNKS}, fl AS (SELECT raw_path AS p, language, CASE WHEN id > 1000 THEN 'unknown' ELSE 'code' END AS type, path, content FROM lo),
fs AS (SELECT p AS path, language, {_ROLE} AS purpose, {_DOM} AS domain, {rules.duck_labels(rules.FILE_TAGS, _DOM, 'language')} AS tags, CASE WHEN contains(p, '/') THEN string_split(p, '/')[1] ELSE '_root' END AS module, string_split(p, '/')[1] AS dep FROM fl),
fx AS (SELECT *, path || ': ' || purpose || '. Contains: text content.' AS s FROM fs)"""
_FLAG = lambda table: "list_filter([" + ", ".join(f"CASE WHEN bool_or({rules.duck(c)}) THEN '{n}' END" for n, c in table) + "], lambda x: x IS NOT NULL)"
_PURPOSE = "CASE " + " ".join("WHEN " + " AND ".join(f"bool_or({rules.duck(c)})" for c in cs) + f" THEN '{n}'" for n, cs in rules.PURPOSES) + " ELSE 'Software project' END"
FLAGS = f"fg AS (SELECT {_FLAG(rules.FRAMEWORKS)}[1:10] AS frameworks, {_FLAG(rules.PROJECT_PATTERNS)}[1:8] AS patterns, {_PURPOSE} AS purpose FROM fl)"
PACKED = rf"""{CHUNKS}, cl AS (SELECT id, content, language, string_split(content, chr(10)) AS l FROM ch),
cm AS (SELECT id, content, language, l, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches({_S('l[i]')}, '{_Q(compress.CRITICAL)}') AND (regexp_matches({_S('l[i]')}, '{_Q(compress.BOILERPLATE)}') OR {_S('l[i]')} = ''))[1 : greatest(len(l) - CAST(ceil(len(l) * 0.6::DOUBLE) AS INT), 0)] AS gone FROM cl),
cc AS (SELECT id, content, language, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) AS code FROM cm),
se AS (SELECT *, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM cc),
tg AS (SELECT *, len(p) AS n, CAST(ceil(len(p) * 0.6::DOUBLE) AS INT) AS target FROM se),
kp AS (SELECT *, list_concat([0, n - 1], list_transform(range(1, greatest(target - 1, 2)), lambda i: CAST(floor(i * (n / CAST(greatest(target - 2, 1) AS DOUBLE)) + 0.5) AS INT))) AS keep FROM tg),
ct AS (SELECT id, content, language, code, CASE WHEN n <= target OR n <= 3 THEN content ELSE array_to_string(list_filter(p, lambda x, i: list_contains(keep, i - 1)), ' ') END AS txt FROM kp),
cx AS (SELECT id, content, {_S("regexp_replace(CASE WHEN language IN ('" + "', '".join(compress.CODE) + r"') THEN code ELSE txt END, '\n{3,}', chr(10) || chr(10), 'g')")} AS compressed FROM ct)"""
RANKED = f"""{WALK}, rt AS (SELECT source AS query_id, CAST(row_number() OVER (PARTITION BY source ORDER BY tokens DESC, k.doc_id, b[2]) AS INT) AS rank, k.doc_id || ':' || b[2] AS id, c AS body, b[3] AS start_line, b[2] AS end_line, source || '/' || k.doc_id AS path, tokens,
'lines ' || b[3] || '-' || b[2] AS title, 1 / (rank + 1) AS score FROM k JOIN documents ON documents.doc_id = k.doc_id QUALIFY rank <= {RETRIEVAL.candidates}), ru AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM rt)"""
_SIG = [r"function\s+\w+\s*\(([^)]*)\)", r"(?:const|let)\s+\w+\s*=\s*(?:async\s*)?\(([^)]*)\)", r"(?:async\s+)?\w+\s*\(([^)]*)\)"]
_PAR = "CASE " + " ".join(f"WHEN regexp_matches(f, '{p}') THEN regexp_extract(f, '{p}', 1)" for p in _SIG) + " ELSE '' END"
ORACLE = {
    "enrich_domain": f"WITH {CHUNKS} SELECT id, {rules.duck(rules.first_of(rules.CHUNK_DOMAIN, 'unknown'))} AS domain FROM lo",
    "enrich_complexity": rf"WITH {CHUNKS}, x AS (SELECT id, least(list_max(list_transform(string_split(raw, chr(10)), lambda y: CAST(floor(length(regexp_extract(y, '^(\s+)', 1)) / 2) AS INT))), 5) + least(len(regexp_extract_all(raw, '{enrich.BRANCHES}')), 10) + CASE WHEN ceil(length(raw) / 4) > 400 THEN 3 WHEN ceil(length(raw) / 4) > 200 THEN 2 WHEN ceil(length(raw) / 4) > 100 THEN 1 ELSE 0 END AS s FROM lo) SELECT id, CASE WHEN s <= 3 THEN 'low' WHEN s <= 7 THEN 'medium' WHEN s <= 12 THEN 'high' ELSE 'very-high' END AS complexity FROM x",
    "enrich_tags": f"WITH {CHUNKS} SELECT id, {_one(rules.duck_labels(rules.CHUNK_TAGS, 'language', 'kind', cap=20))} AS tags FROM lo",
    "enrich_patterns": f"WITH {CHUNKS} SELECT id, {_one(rules.duck_labels(rules.CHUNK_PATTERNS))} AS patterns FROM lo",
    "side_effects": f"WITH {CHUNKS} SELECT id, {_one(rules.duck_labels(rules.CHUNK_EFFECTS))} AS side_effects FROM lo",
    "public_api_flags": f"WITH {CHUNKS} SELECT id, contains(raw, 'export') OR contains(raw, 'public ') OR kind IN ('function', 'class', 'interface') AS is_public_api, regexp_matches(raw_path, '{enrich.ENTRY}') AS is_entry_point FROM lo",
    "responsibilities": f"WITH {CHUNKS} SELECT id, {_one(rules.duck_labels(rules.RESPONSIBILITIES))} AS responsibilities, {_one(rules.duck_labels(rules.SUMMARY_EFFECTS))} AS side_effects FROM lo",
    "signature_info": rf"WITH {CHUNKS}, f AS (SELECT id, language, string_split(raw, chr(10))[1] AS f FROM lo), g AS (SELECT id, language, f, {_PAR} AS ps FROM f) SELECT id, CASE WHEN language IS NULL THEN '' ELSE array_to_string(list_filter(list_transform(string_split(ps, ','), lambda p: {_S("string_split(" + _S('p') + ", ':')[1]")}), lambda p: p <> '')[1:5], ',') END AS inputs, CASE WHEN language IS NOT NULL AND regexp_matches(f, '\):\s*([^{{]+)') THEN {_S(r"regexp_extract(f, '\):\s*([^{]+)', 1)")} ELSE '' END AS outputs FROM g",
    "chunk_summary": rf"WITH {CHUNKS}, s AS (SELECT id, regexp_replace(array_to_string(list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '\S'))[1:5], ' '), '\s+', ' ', 'g') AS s FROM lo) SELECT id, CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || '...' ELSE s END AS summary FROM s",
    "file_summary": f"WITH {FILE} SELECT path, CASE WHEN length(s) > 600 THEN substr(s, 1, 600) || '...' ELSE s END AS summary, purpose, domain, {_one('tags')} AS tags FROM fx",
    "module_summary": f"""WITH {FILE}, mo AS (SELECT module, count(*) AS files, arg_min(purpose, path) AS purpose FROM fx GROUP BY module),
dm AS (SELECT module, domain FROM (SELECT module, domain, count(*) AS n, min(path) AS f FROM fx GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY module ORDER BY n DESC, f) = 1),
de AS (SELECT module, string_agg(dep, ',' ORDER BY f) AS dependencies FROM (SELECT module, dep, min(path) AS f FROM fx GROUP BY ALL) GROUP BY module),
tx AS (SELECT module, path, unnest(tags) AS x, unnest(range(1, len(tags) + 1)) AS i FROM fx), ty AS (SELECT module, x, min(path) AS f, arg_min(i, path) AS i FROM tx GROUP BY ALL), tz AS (SELECT module, string_agg(x, ',' ORDER BY f, i) AS tags FROM ty GROUP BY module)
SELECT module, files, purpose, domain, dependencies, tags, 'Module ''' || module || ''': ' || files || ' files. Purpose: ' || purpose || '. Exports: .' AS summary FROM mo JOIN dm USING (module) JOIN de USING (module) JOIN tz USING (module)""",
    "frameworks_detect": f"WITH {FILE}, {FLAGS} SELECT {_one('frameworks')} AS frameworks, {_one('patterns')} AS patterns, purpose FROM fg",
    "project_languages": f"WITH {CHUNKS} SELECT language, count(*) AS n FROM ch WHERE language IS NOT NULL GROUP BY language ORDER BY n DESC, language LIMIT 5",
    "project_summary": rf"""WITH {FILE}, {FLAGS}, lg AS (SELECT string_agg(language, ', ' ORDER BY n DESC, f) AS l FROM (SELECT language, count(*) AS n, min(p) AS f FROM fl WHERE language IS NOT NULL GROUP BY language ORDER BY n DESC, f LIMIT 5)),
en AS (SELECT string_agg(p, ',' ORDER BY p) AS e FROM (SELECT p FROM fl WHERE regexp_matches(p, '{enrich.PROJECT_ENTRY}') ORDER BY p LIMIT 5)), n AS (SELECT count(*) AS files, count(DISTINCT module) AS modules FROM fx)
SELECT files, modules, coalesce(e, '') AS entry_points, purpose, 'Project ''corpus'': ' || files || ' files across ' || modules || ' modules. Languages: ' || l || '. Frameworks: ' || CASE WHEN len(frameworks) = 0 THEN 'none detected' ELSE array_to_string(frameworks, ', ') END || '.' AS summary FROM n, lg, en, fg""",
    "compress_code": f"WITH {PACKED} SELECT id, code AS compressed FROM cc",
    "compress_text": f"WITH {PACKED} SELECT id, txt AS compressed FROM ct",
    "compress_chunk": f"WITH {PACKED} SELECT id, compressed, CAST(ceil(length(content) / 4) AS BIGINT) AS before, CAST(ceil(length(compressed) / 4) AS BIGINT) AS after FROM cx",
    "compression_totals": f"WITH {PACKED}, t AS (SELECT CAST(ceil(length(content) / 4) AS BIGINT) AS b, CAST(ceil(length(compressed) / 4) AS BIGINT) AS a FROM cx) SELECT CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, CAST(sum(b - a) AS BIGINT) AS saved FROM t",
    "token_budget_context": f"WITH {RANKED} SELECT query_id, rank, id, used FROM ru WHERE used <= {BUDGET}",
    "assemble_context": f"WITH {RANKED} SELECT query_id, string_agg('### ' || title || chr(10) || '// ' || path || ':' || start_line || '-' || end_line || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ru WHERE used <= {BUDGET} GROUP BY query_id",
    "context_package": f"WITH {RANKED} SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (used <= {BUDGET}) AS ids, count(*) FILTER (used <= {BUDGET}) AS kept, CAST(coalesce(sum(tokens) FILTER (used <= {BUDGET}), 0) AS BIGINT) AS tokens, count(*) > count(*) FILTER (used <= {BUDGET}) AS truncated, count(*) - count(*) FILTER (used <= {BUDGET}) AS omitted FROM ru GROUP BY query_id",
    "context_toggles": f"WITH {RANKED}, rl AS (SELECT DISTINCT query_id, path || ' contains ' || title AS r FROM ru WHERE rank <= 3), rj AS (SELECT query_id, string_agg(r, '|' ORDER BY r) AS relations FROM rl GROUP BY query_id), kp AS (SELECT query_id, count(*) FILTER (used <= {BUDGET}) AS kept FROM ru GROUP BY query_id) SELECT query_id, kept, relations FROM kp JOIN rj USING (query_id)",
    "serialize_context": f"WITH {RANKED} SELECT query_id, '# Context for: about ' || query_id || chr(10) || chr(10) || '## Relevant Code' || chr(10) || string_agg('### ' || rank || '. ' || path || ':' || start_line || ' [score: ' || printf('%.2f', score) || ']' || chr(10) || body || chr(10), chr(10) ORDER BY rank) || chr(10) || '## Relations' || chr(10) || string_agg('- ' || path || ' --[contains]--> ' || title, chr(10) ORDER BY '- ' || path || ' --[contains]--> ' || title) || chr(10) AS text FROM ru WHERE rank <= 3 GROUP BY query_id",
}
