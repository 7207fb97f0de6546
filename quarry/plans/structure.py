"""Queries over graphs, parsers and change feeds, and their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.text import make_id
from ..operators import chunking, graph, parsers
from ..streaming import debounce as feed
from . import fixtures
from .common import literal, store_of, table, values
from .retrieval import WALK


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")))
    return d.select(make_id("doc", F.col("path")).alias("id"), "path", F.array("source").alias("dependencies"), F.col("text").alias("content"))


def _doc_graph(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return graph.document_graph(d, chunking.line_blocks(d.select(F.col("id").alias("document_id"), "content")))


def graph_build(spark, sf_dir):
    return _doc_graph(spark, sf_dir)[1].select("id", "source_id", "target_id", "kind", "weight")


def graph_build_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("path"), F.array("lang").alias("dependencies"))
    nodes, edges = graph.chunk_graph(c)
    return nodes.select("id", "kind", F.lit("node").alias("what")).unionByName(edges.select("id", "kind", F.lit("edge").alias("what")))


def graph_stats(spark, sf_dir):
    nodes, edges = _doc_graph(spark, sf_dir)
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def _trade(spark, sf_dir):
    """Regions contain nations, nations contain customers and suppliers, and parts depend on suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), c)
    pairs = lambda df, a, b: df.select(a.alias("source_id"), b.alias("target_id"))
    contains = pairs(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"))
    contains = contains.unionByName(pairs(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"))).unionByName(pairs(t("supplier"), key("n", "s_nationkey"), key("s", "s_suppkey")))
    depends = pairs(t("lineitem").select("l_partkey", "l_suppkey").distinct(), key("p", "l_partkey"), key("s", "l_suppkey"))
    edges = graph.edges_of(contains, "contains", 1.0).unionByName(graph.edges_of(depends, "depends_on", 0.8))
    ids = [key("r", "r_regionkey"), key("n", "n_nationkey"), key("c", "c_custkey"), key("s", "s_suppkey")]
    nodes = None
    for c, n in zip(ids, ("region", "nation", "customer", "supplier")):
        one = t(n).select(c.alias("id"), F.lit(n).alias("kind"))
        nodes = one if nodes is None else nodes.unionByName(one)
    return nodes, edges


def neighbors_depth2(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    with store_of(spark) as (store, kept):  # the edges are made once, not in every step
        store.commit(lambda c: c.append("edges", edges.select("source_id", "target_id", "kind")))
        return kept(graph.neighbours(nodes, store.read("edges"), literal(spark, [("r1",), ("c1",)], "id string"), 2))


def neighbors_capped(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return graph.neighbours(nodes, edges, literal(spark, [("r1",), ("c1",)], "id string"), 2, ["contains"], 10)


def edge_kind_filter(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    return graph.edges_at(edges, literal(spark, [("s1",), ("s2",), ("n3",)], "id string"), "target_id", ["depends_on"]).select("id", "source_id", "target_id")


def shortest_path(spark, sf_dir):
    _, edges = _trade(spark, sf_dir)
    pairs = literal(spark, [("r1", "c1"), ("r0", "c5"), ("r2", "c9"), ("p1", "s1"), ("r3", "r3"), ("c1", "r1")], "source_id string, target_id string")
    nation = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("source_id"), F.concat(F.lit("c"), "c_custkey").alias("target_id"))
    region = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("r"), F.concat(F.lit("n"), "n_nationkey").alias("source_id"))
    every = nation.join(region, "source_id").select(F.col("r").alias("source_id"), "target_id")
    with store_of(spark) as (store, kept):  # edges and steps are made once
        number = itertools.count()

        def keep(df):
            name = f"step{next(number)}"
            store.commit(lambda c: c.append(name, df))
            return store.read(name)

        return kept(graph.shortest_paths(edges, pairs.unionByName(every), keep=keep).select("source_id", "target_id", F.array_join("path", ">").alias("path")))


def _of(spark, rows, language):
    return literal(spark, rows, "id long, path string, content string").withColumn("language", F.lit(language))


def csv_schema(spark, sf_dir):
    return parsers.csv_facts(_of(spark, fixtures.CSV, "csv")).select("id", F.array_join("headers", ",").alias("headers"), "row_count", "column_count", "schema", "sample")


def markdown_sections(spark, sf_dir):
    return parsers.markdown_sections(_of(spark, fixtures.MARKDOWN, "markdown"))


def markdown_tags(spark, sf_dir):
    return parsers.markdown_facts(_of(spark, fixtures.MARKDOWN, "markdown")).select("id", F.array_join("tags", ",").alias("tags"), "code_blocks")


def json_sections(spark, sf_dir):
    return parsers.json_sections(_of(spark, fixtures.JSON_FILES, "json"))


def json_props(spark, sf_dir):
    """The top-level keys of the events' JSON: the same parser at scale."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("p").alias("path"), F.col("props").alias("content"))
    return parsers.json_sections(e).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def dockerfile_blocks(spark, sf_dir):
    return parsers.dockerfile_blocks(_of(spark, fixtures.DOCKER, "dockerfile"))


def config_blocks(spark, sf_dir):
    return parsers.blank_line_blocks(_of(spark, fixtures.INI, "ini"))


def imports_extract(spark, sf_dir):
    c = literal(spark, fixtures.CODE, "id long, path string, kind string, language string, title string, content string")
    return parsers.imports(c).select("id", F.array_join("imports", "|").alias("imports"))


def code_symbols(spark, sf_dir):
    return parsers.symbols(literal(spark, fixtures.CODE, "id long, path string, kind string, language string, title string, content string"))


def code_chunks(spark, sf_dir):
    c = literal(spark, fixtures.CODE, "id long, path string, kind string, language string, title string, content string")
    s = parsers.symbols(c).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "kind", "start_line", "end_line"))), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))).alias("symbols"))
    docs = c.join(s, "id", "left").select(F.col("id").alias("document_id"), "content", "symbols")
    return chunking.code_chunks(docs)


def debounce_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return feed.debounce(e, 3_600_000).select("key", "kind", "event_id")


QUERIES = {f.__name__: f for f in (
    graph_build, graph_build_chunks, graph_stats, neighbors_depth2, neighbors_capped, edge_kind_filter, shortest_path, csv_schema, markdown_sections, markdown_tags,
    json_sections, json_props, dockerfile_blocks, config_blocks, imports_extract, code_symbols, code_chunks, debounce_events,
)}

_ID = lambda prefix, x: f"'{prefix}_' || substr(sha256({x}), 1, 16)"
DOCG = f"""WITH {WALK}, dd AS (SELECT doc_id, {_ID('doc', "source || '/' || doc_id || '.txt'")} AS id, source FROM documents),
ck AS (SELECT dd.id AS s, {_ID('chunk', "dd.id || ':' || idx")} AS t FROM o JOIN dd ON dd.doc_id = o.document_id), dp AS (SELECT DISTINCT id AS s, {_ID('doc', 'source')} AS t FROM dd),
eg AS (SELECT s AS source_id, t AS target_id, 'contains' AS kind, 1.0::DOUBLE AS weight FROM ck UNION ALL SELECT s, t, 'depends_on', 0.8::DOUBLE FROM dp)"""
TRADE = """ed AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t, 'contains' AS k FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'depends_on' FROM lineitem),
no AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)"""
_NEAR = lambda where: f"WITH RECURSIVE {TRADE}, bo AS (SELECT s AS u, t AS v FROM ed {where} UNION SELECT t, s FROM ed {where}), w AS (SELECT id, 0 AS depth FROM (VALUES ('r1'), ('c1')) AS t(id) UNION SELECT v, depth + 1 FROM w JOIN bo ON u = id WHERE depth < 2), b AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) SELECT id, CAST(depth AS INT) AS depth FROM b WHERE id IN (SELECT id FROM no)"
_IMPORT = r"(?m)^\s*((?:import|from|use|package|require|#include)\b[^\n]*)"
_BLOCK = lambda rows, opens: f"ln AS (SELECT id, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT CAST(id AS BIGINT) AS id, path, string_split(content, chr(10)) AS l FROM {values(rows, 'id, path, content')})), bl AS (SELECT id, i, l[i] AS line, sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS p FROM ln)"
_MD = rf"ln AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT CAST(id AS BIGINT) AS id, string_split(content, chr(10)) AS l FROM {values(fixtures.MARKDOWN, 'id, path, content')})), fe AS (SELECT id, i, l[i] AS line, starts_with(l[i], '```') OR starts_with(l[i], '~~~') AS f FROM ln), si AS (SELECT *, sum(CAST(f AS INT)) OVER (PARTITION BY id ORDER BY i) % 2 = 1 AS ins FROM fe), he AS (SELECT *, sum(CASE WHEN NOT f AND NOT ins AND regexp_matches(line, '^#{{1,6}}\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM si)"
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_CELL = lambda x: f"list_transform(string_split({x}, ','), lambda v: regexp_replace({_STRIP('v')}, '^\"|\"$', '', 'g'))"
ORACLE = {
    "graph_build": f"{DOCG} SELECT {_ID('edge', 'source_id || chr(58) || target_id || chr(58) || kind')} AS id, source_id, target_id, kind, weight FROM eg",
    "graph_build_chunks": f"WITH e AS (SELECT DISTINCT 'file:' || source AS s, 'c' || doc_id AS t, 'contains' AS kind FROM documents UNION SELECT 'c' || doc_id, 'dep:' || lang, 'imports' FROM documents) SELECT 'c' || doc_id AS id, 'chunk' AS kind, 'node' AS what FROM documents UNION ALL SELECT DISTINCT 'file:' || source, 'file', 'node' FROM documents UNION ALL SELECT DISTINCT 'dep:' || lang, 'file', 'node' FROM documents UNION ALL SELECT {_ID('edge', 's || chr(58) || t || chr(58) || kind')}, kind, 'edge' FROM e",
    "graph_stats": f"{DOCG} SELECT (SELECT count(*) FROM dd) + (SELECT count(*) FROM ck) AS nodes, (SELECT count(*) FROM eg) AS edges",
    "neighbors_depth2": _NEAR(""),
    "neighbors_capped": _NEAR("WHERE k = 'contains'") + " ORDER BY depth, id LIMIT 10",
    "edge_kind_filter": f"WITH {TRADE} SELECT {_ID('edge', 's || chr(58) || t || chr(58) || k')} AS id, s AS source_id, t AS target_id FROM ed WHERE k = 'depends_on' AND t IN ('s1', 's2', 'n3')",
    "shortest_path": f"WITH {TRADE}, pr AS (SELECT * FROM (VALUES ('r1', 'c1'), ('r0', 'c5'), ('r2', 'c9'), ('p1', 's1'), ('r3', 'r3'), ('c1', 'r1')) AS t(a, b) UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey), pa AS (SELECT a, b, a AS p, 0 AS n FROM pr WHERE a = b UNION ALL SELECT a, b, a || '>' || b, 1 FROM pr JOIN ed ON s = a AND t = b UNION ALL SELECT a, b, a || '>' || x.t || '>' || b, 2 FROM pr JOIN ed x ON x.s = a JOIN ed y ON y.s = x.t AND y.t = b) SELECT a AS source_id, b AS target_id, arg_min(p, n || p) AS path FROM pa GROUP BY ALL",
    "csv_schema": f"WITH c AS (SELECT CAST(id AS BIGINT) AS id, list_filter(string_split(content, chr(10)), lambda x: {_STRIP('x')} <> '') AS l FROM {values(fixtures.CSV, 'id, path, content')}), h AS (SELECT id, {_CELL('l[1]')} AS h, len(l) - 1 AS n, list_transform(l[2:6], lambda r: array_to_string({_CELL('r')}, ' | ')) AS r FROM c) SELECT id, array_to_string(h, ',') AS headers, CAST(n AS INT) AS row_count, CAST(len(h) AS INT) AS column_count, 'Headers: ' || array_to_string(h, ', ') || chr(10) || 'Row count: ' || n AS schema, array_to_string(list_concat([array_to_string(h, ' | ')], r), chr(10)) AS sample FROM h",
    "markdown_sections": rf"WITH {_MD} SELECT id, CAST(pos AS INT) AS pos, {_STRIP(r"regexp_extract(arg_min(line, i), '^#{1,6}\s+(.+)$', 1)")} AS title, CAST(length(regexp_extract(arg_min(line, i), '^(#{{1,6}})', 1)) AS INT) AS level, string_agg(line, chr(10) ORDER BY i) AS content, CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line FROM he WHERE pos >= 0 GROUP BY id, pos",
    "markdown_tags": rf"WITH m AS (SELECT CAST(id AS BIGINT) AS id, content, list_transform(regexp_extract_all(' ' || replace(content, '#', '##'), '[^\w#]##?[a-zA-Z][a-zA-Z0-9_-]*'), lambda x: regexp_replace(x, '^[^#]*#+', '')) AS t FROM {values(fixtures.MARKDOWN, 'id, path, content')}) SELECT id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:20], ',') AS tags, CAST(floor(len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '```') OR starts_with(x, '~~~'))) / 2) AS INT) AS code_blocks FROM m",
    "json_sections": f"WITH j AS (SELECT CAST(id AS BIGINT) AS id, path, content, json_valid(content) AS ok FROM {values(fixtures.JSON_FILES, 'id, path, content')}), k AS (SELECT id, ok, CASE WHEN NOT ok THEN [path] WHEN json_type(CASE WHEN ok THEN content ELSE 'null' END) <> 'OBJECT' THEN ['root'] ELSE json_keys(CASE WHEN ok THEN content ELSE '{{}}' END) END AS t FROM j) SELECT id, ok AS parsed, CAST(unnest(range(len(t))) AS INT) AS pos, unnest(t) AS title FROM k",
    "json_props": "SELECT title, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS title FROM events) GROUP BY title",
    "dockerfile_blocks": f"WITH {_BLOCK(fixtures.DOCKER, chr(39).join(('regexp_matches(l[i], ', '^(FROM|RUN|COPY|CMD|ENTRYPOINT)', ')')))}, a AS (SELECT id, p, string_agg(line, chr(10) ORDER BY i) AS content, min(i) AS a, max(i) AS b, arg_min(line, i) AS f FROM bl GROUP BY id, p) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS INT) AS pos, string_split(f, ' ')[1] AS title, content, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM a",
    "imports_extract": rf"WITH {'c AS (SELECT CAST(id AS BIGINT) AS id, content FROM ' + values(fixtures.CODE, 'id, path, kind, language, title, content') + ')'} SELECT id, array_to_string(list_transform(regexp_extract_all(content, '{_IMPORT}', 1)[1:50], lambda x: {_STRIP('x')}), '|') AS imports FROM c",
    "debounce_events": "WITH e AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS kind, event_id, epoch_ms(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_ms(ts) AS w FROM events) SELECT key, kind, event_id FROM e WHERE w IS NULL OR w > 3600000",
}
