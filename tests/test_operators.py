import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import files
from quarry.operators import cells, chunking, compress, enrich, fusion, graph, lexical, models, parsers, vectors
from quarry.sources import scan
from quarry.sources.store import Store
from quarry.streaming import debounce as feed


def test_scan_directory(spark, tmp_path):
    for path, body in {"src/index.ts": b"export const a = 1;\n", "README.md": b"# Hi\n", "node_modules/foo/index.js": b"x", "img.png": b"\x89PNG", "bin.dat": b"a\x00b", "bom.txt": b"\xef\xbb\xbfhi", ".gitignore": b"node_modules\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    rows = {r["relative_path"]: r for r in scan.scan_directory(spark, str(tmp_path), include_binary=True).collect()}
    assert "node_modules/foo/index.js" not in rows and rows["src/index.ts"]["language"] == "typescript" and rows["README.md"]["language"] == "markdown"
    assert rows["img.png"]["is_binary"] and rows["bin.dat"]["is_binary"] and rows["bom.txt"]["encoding"] == "utf-8-bom"
    assert len(rows["README.md"]["hash"]) == 16
    assert "img.png" not in {r["relative_path"] for r in scan.scan_directory(spark, str(tmp_path)).collect()}


def test_ignore_files_of_the_tree(spark, tmp_path):
    """Patterns that the fixed list lacks, from both ignore files."""
    for path, body in {"src/a.ts": "x", "secret/b.ts": "x", "src/notes.tmp": "x", "src/keep.tmp": "x", "private/c.md": "x", ".gitignore": "secret/\n# note\n*.tmp\n!keep.tmp\n", ".ragignore": "private\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    got = {r["relative_path"] for r in scan.scan_directory(spark, str(tmp_path)).collect()}
    assert {x for x in got if not x.startswith(".")} == {"src/a.ts", "src/keep.tmp"}
    assert "src/a.ts" not in {r["relative_path"] for r in scan.scan_directory(spark, str(tmp_path), ["*.ts"]).collect()}


def test_ignore_negation(spark):
    df = spark.createDataFrame([("a/x.log",), ("keep.log",), ("b/c.txt",)], "path string")
    got = {r["path"] for r in df.where(~files.ignored(F.col("path"), ["*.log", "!keep.log", "# note", "b/"])).collect()}
    assert got == {"keep.log"}


def test_snapshots(spark, tmp_path):
    s = scan.Snapshots(spark, str(tmp_path))
    assert s.read("t") is None
    s.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"])
    s.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    s.delete("t", spark.createDataFrame([(1,)], "k long"), ["k"])
    assert sorted(map(tuple, s.read("t").collect())) == [(2, "c"), (3, "d")] and s.versions("t") == [1, 2, 3]


def literal_blocks(text, limit=512, overlap=16, least=20):
    lines, out, buf, tokens, start = text.split("\n"), [], [], 0, 1
    size = lambda x: -(-len(x) // 4)
    for i, line in enumerate(lines):
        if tokens + size(line) > limit and buf:
            if size("\n".join(buf)) >= least:
                out.append(("\n".join(buf), start, i))
            buf = buf[-overlap:]
            tokens, start = size("\n".join(buf)), i - overlap + 1
        buf.append(line)
        tokens += size(line)
    if size("\n".join(buf)) >= least:
        out.append(("\n".join(buf), start, len(lines)))
    return out


def test_line_blocks_follow_the_loop(spark):
    import random

    rnd = random.Random(5)
    docs = [(i, "\n".join("x" * rnd.choice((0, 3, 40, 90, 700, 2500)) for _ in range(rnd.randint(1, 60)))) for i in range(60)] + [(99, ""), (100, None)]
    got = {}
    for r in chunking.line_blocks(spark.createDataFrame(docs, "document_id long, content string")).orderBy("document_id", "idx").collect():
        got.setdefault(r["document_id"], []).append((r["content"], r["start_line"], r["end_line"]))
    for i, text in docs:
        assert got.get(i, []) == literal_blocks(text or "")


def test_code_chunks(spark):
    big = "class A {\n" + "".join(f"  m{i}() {{\n    return '{'y' * 900}';\n  }}\n" for i in range(5)) + "}"
    rows = [(1, big, "typescript"), (2, "// nothing here but a long enough comment line that makes twenty tokens in all, surely it does\n" * 2, "go")]
    files_ = spark.createDataFrame(rows, "id long, content string, language string")
    s = parsers.symbols(files_).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "kind", "end_line"))).alias("symbols"))
    docs = files_.join(s, "id", "left").select(F.col("id").alias("document_id"), "content", "symbols")
    got = chunking.code_chunks(docs).collect()
    kinds = [r["kind"] for r in sorted(got, key=lambda r: (r["document_id"], r["pos"], r["part"]))]
    assert kinds == ["method"] * 5 + ["fallback"]


def test_porter():
    words = {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "relational": "relat", "happy": "happi", "agreed": "agre", "falling": "fall", "filing": "file", "generalization": "gener", "sky": "sky", "adoption": "adopt", "controll": "control"}
    assert {w: lexical.porter(w) for w in words} == words


def test_search_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "id long, text string")
    q = spark.createDataFrame([(1, ["a"]), (2, ["zz"]), (3, [])], "query_id long, terms array<string>")
    got = lexical.score(lexical.asked_of(q), lexical.postings(docs).withColumnRenamed("term", "asked"), lexical.lengths(docs), 1).collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 1)]


def test_terms_after_the_first_10_000_characters_are_found(spark):
    docs = spark.createDataFrame([(1, "aa " * 4000 + "latecomer"), (2, "aa bb")], "id long, text string")
    index, length = lexical.postings(docs), lexical.lengths(docs)
    assert {(r["term"], r["id"], r["tf"]) for r in index.collect()} == {("aa", 1, 4000), ("latecomer", 1, 1), ("aa", 2, 1), ("bb", 2, 1)}
    assert {(r["id"], r["n"]) for r in length.collect()} == {(1, 4001), (2, 2)}
    q = spark.createDataFrame([(1, ["latecomer"])], "query_id long, terms array<string>")
    assert [r["id"] for r in lexical.score(lexical.asked_of(q), index.withColumnRenamed("term", "asked"), length, 5).collect()] == [1]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, vector array<float>")
    got = [(r["query_id"], r["id"], r["score"]) for r in vectors.top_k(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(7, 1, 1.0), (7, 5, 1.0)] and all(s == 0 for _, _, s in got[2:])
    assert vectors.top_k(q.limit(0), v, 2).count() == 0 and vectors.top_k(q, v.limit(0), 2).count() == 0


def test_cache(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], 10, 100), (2, [0.0, 1.0], 20, 5)], "id long, embedding array<float>, created_at long, expires_at long")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    assert [tuple(r) for r in vectors.cache_lookup(q, c, 50).collect()] == [(1, 1, 1.0)]
    kept = vectors.cache_put(c, spark.createDataFrame([(1, [1.0, 1.0], 30, 100)], c.schema), 1)
    assert [(r["id"], r["created_at"]) for r in kept.collect()] == [(1, 30)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "ts", "auth", "class", ["a"], "src/x.ts"), (2, "py", "auth", "class", [], "lib/y.py")], "id long, language string, domain string, kind string, tags array<string>, relative_path string")
    ids = lambda **k: [r["id"] for r in fusion.filtered(df, **k).collect()]
    assert ids(languages=["ts"]) == [1] and ids(tags=["a"]) == [1] and ids(paths=["lib"]) == [2] and ids(domains=["auth"], kinds=["class"]) == [1, 2]


def test_compress(spark):
    code = "import { a } from 'b';\n// comment\nexport function f(x) {\n  const y = 1;\n\n  // more\n  if (x) {\n    return y;\n  }\n}"
    out = spark.createDataFrame([(code, "typescript"), ("One. Two. Three. Four. Five. Six.", None), (None, "go")], "c string, l string").select(compress.compress(F.col("c"), F.col("l")).alias("x")).collect()
    assert "return y" in out[0]["x"] and "if (x)" in out[0]["x"] and "import" not in out[0]["x"]
    assert out[1]["x"].startswith("One.") and out[1]["x"].endswith("Six.") and out[2]["x"] is None


def test_enrich_fixtures(spark):
    body = "export async function f() {\n  const t = await jwt.verify(x);\n  console.log(t);\n  db.insert(t);\n  bus.emit('x');\n}"
    deep = "\n".join("  " * (i % 12) + "if (a) { for (;;) {} }" for i in range(50)) + "x" * 2000
    df = spark.createDataFrame([(1, "src/a.ts", "function", "typescript", "f", body), (2, "index.ts", "function", "typescript", "g", deep)], "id long, path string, kind string, language string, title string, content string")
    a, b = enrich.enriched(df).orderBy("id").collect()
    assert a["domain"] == "auth" and "async" in a["tags"] and "console-output" in a["side_effects"] and a["is_public_api"]
    assert b["complexity"] in ("high", "very-high") and b["is_entry_point"]


def test_graph(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = graph.edges_of(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "gone")], "source_id string, target_id string"), "contains", 1.0)
    near = {(r["id"], r["depth"]) for r in graph.neighbours(n, e, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert near == {("a", 0), ("b", 1), ("c", 1)}
    p = graph.shortest_paths(e, spark.createDataFrame([("a", "c"), ("c", "b"), ("gone", "a")], "source_id string, target_id string")).collect()
    assert {(r["source_id"], r["target_id"]): r["path"] for r in p} == {("a", "c"): ["a", "b", "c"], ("c", "b"): ["c", "a", "b"]}
    assert [r["id"] for r in graph.keep_last(spark.createDataFrame([(1, 1), (1, 2)], "id long, seq long"), "id", "seq").collect()] == [1]


def generic_loop(text):
    out, cur, start = [], [], 1
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line.strip() == "" and cur:
            out.append(("\n".join(cur), start, i))
            cur, start = [], i + 2
        else:
            cur.append(line)
    if cur:
        out.append(("\n".join(cur), start, len(lines)))
    return out or [(text, 1, len(lines))]


def test_blank_line_blocks_follow_the_loop(spark):
    texts = ["[a]\nx=1\n\n[b]\ny=2\n\n\nz=3", "one", "a\n\n\n\nb", "\na\n", "\n\n\na", "", "a\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {}
    for r in parsers.blank_line_blocks(df).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["content"], r["start_line"], r["end_line"]))
    assert got == {i: generic_loop(t) for i, t in enumerate(texts)}


def test_tree_sections(spark):
    df = spark.createDataFrame([(1, "a.yaml", "yaml", "a: 1\nb: [1, 2]"), (2, "b.toml", "toml", "[x]\ny = 1"), (3, "c.toml", "toml", "= bad"), (4, "d.yaml", "yaml", "just text")], "id long, path string, language string, content string")
    got = {(r["id"], r["title"], r["parsed"]) for r in parsers.tree_sections(df).collect()}
    assert got == {(1, "a", True), (1, "b", True), (2, "x", True), (3, "c.toml", False), (4, "root", True)}


def test_debounce_stream_and_apply(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [(1, "change", at(0), 1), (1, "unlink", at(1), 2), (1, "change", at(100), 3), (2, "change", at(5), 4), (9, "change", at(100_000), 5)]
    schema = "key long, kind string, ts timestamp, event_id long"
    batch = spark.createDataFrame(rows, schema)
    want = {(r["key"], r["event_id"]) for r in feed.debounce(batch, 10_000).collect()}
    assert want == {(1, 2), (1, 3), (2, 4), (9, 5)}
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = feed.debounce_stream(stream, 10_000, "1 second").writeStream.format("memory").queryName("burst").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["event_id"]) for r in spark.sql("SELECT * FROM burst").collect()}
    assert got == want - {(9, 5)}
    store = scan.Snapshots(spark, str(tmp_path / "store"))
    apply = feed.apply_changes(store, "t", "key")
    changes = spark.createDataFrame([(1, "change", "a"), (2, "change", "b")], "key long, kind string, v string")
    apply(changes, 0)
    apply(spark.createDataFrame([(1, "unlink", None), (2, "change", "c")], changes.schema), 1)
    apply(spark.createDataFrame([(1, "unlink", None), (2, "change", "c")], changes.schema), 1)
    assert [(r["key"], r["v"]) for r in store.read("t").collect()] == [(2, "c")]


def test_top_k_in_blocks_against_brute_force(spark, monkeypatch):
    """Many blocks of both sides, ties, groups and text ids."""
    import random

    import numpy as np

    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    monkeypatch.setattr(vectors, "VECTOR_ROWS", 7)
    rnd = random.Random(2)
    vec = lambda: [float(rnd.randint(-2, 2)) for _ in range(3)]
    v = [(f"v{i:02}", vec(), i % 4) for i in range(60)]
    q = [(f"q{i}", vec(), g) for i in range(11) for g in rnd.sample(range(4), 2)]
    q = [(i, next(x for j, x, _ in q if j == i), g) for i, _, g in q]

    def brute(k, by):
        out = set()
        for i in {i for i, _, _ in q}:
            groups, a = {g for j, _, g in q if j == i}, np.array(next(x for j, x, _ in q if j == i))
            cos = lambda b: 0.0 if not a.any() or not b.any() else round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
            best = sorted((-cos(np.array(b)), n) for n, b, g in v if not by or g in groups)[:k]
            out |= {(i, n, r + 1) for r, (_, n) in enumerate(best)}
        return out

    vs, qs = spark.createDataFrame(v, "id string, embedding array<float>, g int"), spark.createDataFrame(q, "query_id string, vector array<float>, g int")
    assert {(r["query_id"], r["id"], r["rank"]) for r in vectors.top_k(qs, vs, 5, by="g").collect()} == brute(5, True)
    assert {(r["query_id"], r["id"], r["rank"]) for r in vectors.top_k(qs.select("query_id", "vector").distinct(), vs, 70).collect()} == brute(70, False)


def test_hierarchy_with_many_modules(spark):
    """The nearest vectors of all lie in a module whose mean points elsewhere: only the chosen modules' and files' chunks come back, and all of them can."""
    rows = [(i, [1.0, 0.01 * i, 0.0], "hot", "hot/a") for i in range(300)] + [(1000 + i, [-9.0, 0.0, 0.0], "hot", "hot/b") for i in range(300)]
    rows += [(2000 + 10 * m + j, [1.0, 0.5 + 0.01 * m, 0.1 * j], f"m{m:02}", f"m{m:02}/{j % 2}") for m in range(40) for j in range(6)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>, module string, file string")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0])], "query_id long, vector array<float>")
    got = [r["id"] for r in fusion.hierarchical(q, chunks).orderBy("rank").collect()]
    assert len(got) == 10 and all(2000 <= i < 2030 for i in got)
    assert [r["id"] for r in fusion.hierarchical(q, chunks, levels=()).orderBy("rank").collect()] == list(range(10))


def test_stored_index(spark, tmp_path):
    index = lexical.Index(Store(spark, str(tmp_path)), stemmed=True)
    ask = lambda *terms, by="word": [r["id"] for r in index.search(spark.createDataFrame([(1, list(terms))], "query_id long, terms array<string>"), 5, by).orderBy("rank").collect()]
    docs = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    index.write(docs((1, "function testFn returns the answer to everything"), (2, "nothing here"), (3, None)))
    assert ask("testfn") == [1] and ask("xyznonexistent") == [] and ask("ans", "not", by="prefix") == [2, 1] and ask("return", by="stem") == [1]
    index.upsert(docs((1, "changed"), (4, "testFn again")))
    assert ask("testfn") == [4] and ask("changed") == [1] and ask("answer") == []
    index.delete(docs((4, "")))
    assert ask("testfn") == [] and index.segments() == 2
    index.merge()
    assert index.segments() == 1 and ask("changed") == [1] and ask("testfn") == [] and index.store.read("fts-lengths").count() == 3
    index.upsert(docs((4, "testFn back")))
    assert ask("testfn") == [4]


def test_repeated_ids_in_an_index(spark, tmp_path):
    """Of several rows with one id the last counts, in the first write of an index and later; a batch that comes again changes nothing."""
    index = lexical.Index(Store(spark, str(tmp_path)))
    rows = spark.createDataFrame([(1, "the cat sat", 1), (2, "dog ran far away", 1), (1, "the cat sat", 2)], "id long, text string, at int")
    q = spark.createDataFrame([(1, ["cat"]), (2, ["mouse"])], "query_id long, terms array<string>")
    index.upsert(rows, "at", "s", 0)
    once = index.search(q.where("query_id = 1")).collect()
    assert [(r["id"], r["score"]) for r in once] == [(1, 1e-06)]  # idf at its floor; 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 3.5)) = 1.06 of it
    assert [(r["id"], r["score"]) for r in lexical.Index(index.store, "own").write(rows, order="at").search(q.where("query_id = 1")).collect()] == [(1, 1e-06)]
    index.upsert(spark.createDataFrame([(1, "a mouse", 3), (1, "a cat", 4)], rows.schema), "at", "s", 1)
    before = index.store.manifest()
    index.upsert(spark.createDataFrame([(1, "a mouse", 5)], rows.schema), "at", "s", 1)
    assert index.store.manifest() == before and [(r["query_id"], r["id"]) for r in index.search(q).collect()] == [(1, 1)]


def test_no_cartesian_product_in_searches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab")], "id long, text string")
    q = spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>")
    plan = lexical.Index(Store(spark, str(tmp_path))).write(docs).search(q, 5, "prefix")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # the one row of totals


def test_folded_diacritics(spark):
    words = ["Ação", "müßig", "école", "ÅNGSTRÖM", "plain", "e\u0301tude"]
    got = [r["x"] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(F.lower(lexical.fold(F.col("w"))).alias("x")).collect()]
    assert got == ["acao", "mußig", "ecole", "angstrom", "plain", "etude"]


def test_parse_and_chunk_by_type(spark):
    files_ = spark.createDataFrame([
        (1, "a.ts", "typescript", False, "class A {\n  // a brace } in a comment\n  go() { return '}'; }\n}\nfunction f() {\n}"), (2, "b.md", "markdown", False, "# T\n" + "word " * 40),
        (3, "c.csv", "csv", False, "id,name\n1,x"), (4, "d.json", "json", False, '{"k": 1}'), (5, "e.zzz", None, False, "plain text " * 30), (6, "f.png", None, True, "x"), (7, "g.ini", "ini", False, "a=1\n\nb=2"),
    ], "id long, path string, language string, is_binary boolean, content string")
    got = parsers.parse(files_).collect()
    assert {(r["id"], r["type"], r["title"]) for r in got} == {
        (1, "code", "class: A"), (1, "code", "method: go"), (1, "code", "function: f"), (2, "documentation", "T"), (3, "data", "Schema"), (3, "data", "Sample Data"),
        (4, "config", "k"), (5, "unknown", "segment_0"), (7, "config", "block_0"), (7, "config", "block_1"),
    }
    assert {(r["start_line"], r["end_line"]) for r in got if r["title"] == "class: A"} == {(1, 4)}
    docs = files_.select(F.col("id").alias("document_id"), F.when(F.col("id") == 2, "documentation").alias("type"), "content")
    sections = parsers.parse(files_).where("id = 2").withColumnRenamed("id", "document_id")
    assert {(r["document_id"], r["kind"]) for r in chunking.chunk_documents(docs, sections=sections).collect()} == {(1, "fallback"), (2, "section"), (5, "fallback")}
    # Whatever its type says, a document without symbols or sections is cut by lines, with tables given or not.
    long = "some words of text\n" * 20
    every = spark.createDataFrame([(1, "code", long), (2, "documentation", long), (3, "data", long), (4, None, long), (5, "config", long)], "document_id long, type string, content string")
    nothing = spark.createDataFrame([], "document_id long, symbols array<struct<name:string,kind:string,start_line:int,end_line:int>>")
    for kw in ({}, {"symbols": nothing}, {"sections": sections.limit(0)}, {"symbols": nothing, "sections": sections.limit(0)}):
        assert {(r["document_id"], r["kind"]) for r in chunking.chunk_documents(every, **kw).collect()} == {(i, "fallback") for i in range(1, 6)}


def test_last_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at int")
    got = scan.upsert(rows.limit(0), rows, ["k"], "at")
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "b"), (2, "c")]


def test_changes_of_one_key_in_a_batch(spark, tmp_path):
    store = scan.Snapshots(spark, str(tmp_path))
    apply = feed.apply_changes(store, "t", "key", "at")
    apply(spark.createDataFrame([(1, "change", "a", 1), (1, "unlink", None, 2), (2, "unlink", None, 1), (2, "change", "b", 2)], "key long, kind string, v string, at int"), 0)
    assert [(r["key"], r["v"]) for r in store.read("t").collect()] == [(2, "b")]


def test_store_writes_touched_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "k long, j string, v string")
    assert store.read("t") is None and store.manifest()["version"] == 0
    store.commit(lambda c: (c.upsert("t", rows(*[(i, None if i % 2 else "x", "a") for i in range(200)]), ["k", "j"], buckets=16), c.append("log", rows((0, "", "first")))))
    first = store.manifest()["tables"]["t"]["parts"]
    store.commit(lambda c: (c.upsert("t", rows((3, None, "b"), (3, None, "c")), ["k", "j"], "v"), c.append("log", rows((1, "", "second")))))
    second = store.manifest()["tables"]["t"]["parts"]
    assert sum(first[b] != second[b] for b in first) == 1 and store.read("t").count() == 200
    assert [r["v"] for r in store.read("t").where("k = 3").collect()] == ["c"] and store.read("log").count() == 2
    assert [r["v"] for r in store.lookup("t", rows((3, None, ""), (4, None, ""), (999, None, ""))).collect()] == ["c"]
    store.commit(lambda c: c.delete("t", rows((3, None, ""), (4, None, ""))))
    assert store.read("t").count() == 199

    def broken(c):
        c.upsert("t", rows((1000, "y", "never")), ["k", "j"])
        raise RuntimeError("in the middle")

    with pytest.raises(RuntimeError):
        store.commit(broken)
    assert store.read("t").count() == 199
    store.vacuum()
    assert store.read("t").count() == 199 and len(store.names("manifests")) == 1


def test_two_writers_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a")], "k long, v string")

    def slow(c):
        Store(spark, str(tmp_path)).commit(lambda other: other.append("log", one))
        c.append("log", one)

    with pytest.raises(Exception, match="exist"):
        store.commit(slow)
    assert store.read("log").count() == 1


def test_batches_are_applied_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    also = lambda c, changed, gone: c.append("seen", changed.select("key"))
    apply = feed.apply_to(store, "s", "t", ["key"], "at", also)
    rows = lambda *r: spark.createDataFrame(r, "key long, kind string, v string, at int")
    apply(rows((1, "change", "a", 1), (1, "unlink", None, 2), (2, "unlink", None, 1), (2, "change", "b", 2)), 0)
    before = store.manifest()
    apply(rows((7, "change", "again", 1)), 0)
    assert store.manifest() == before
    apply(rows((2, "unlink", None, 3), (3, "change", "c", 3)), 1)
    assert [(r["key"], r["v"]) for r in store.read("t").collect()] == [(3, "c")] and sorted(r["key"] for r in store.read("seen").collect()) == [2, 3]


class Counted:
    def __init__(self, fail=()):
        self.fail, self.calls = set(fail), 0

    def __call__(self, texts):
        self.calls += 1
        if self.calls in self.fail:
            raise ConnectionError("planned")
        return [[float(len(t)), float(len(texts))] for t in texts]


def test_embedder_protocol(spark, tmp_path):
    assert list(models.calls_of(["a" * 5] * 5, 2, 100)) == [(0, 2), (2, 4), (4, 5)] and list(models.calls_of(["a" * 90, "b" * 20, "c" * 200, "d"], 32, 100)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(10)], "id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in models.embedded(df, Counted({1, 2, 5}), rows=4, wait=0.0).collect()}
    assert got == {i: [float(i), 4.0 if i < 8 else 2.0] for i in range(10)}
    with pytest.raises(Exception, match="planned"):
        models.embedded(df, Counted(range(1, 9)), retries=3, wait=0.0).collect()
    cache = models.EmbeddingCache(Store(spark, str(tmp_path)), max_bytes=16 * 12)
    for n in (4, 10, 10):
        out = cache.embed(df.where(F.col("id") < n).unionByName(df.where(F.col("id") < n)), Counted(), wait=0.0)
    assert out.count() == 20 and sorted((r["run"], r["entries"]) for r in cache.runs().collect()) == [(1, 4), (2, 6)]
    cache.evict()
    assert sorted((r["run"], r["entries"]) for r in cache.runs().collect()) == [(1, 4), (2, 6)]
    cache.max_bytes = 16 * 7
    cache.evict()
    assert [(r["run"], r["entries"]) for r in cache.runs().collect()] == [(2, 6)]


def down(query, texts):
    if query == "bad":
        raise ConnectionError("planned")
    return [float(t.count(query)) for t in texts]


def test_reranker_protocol(spark):
    rows = [(q, name, i, "x" * i + name, float(10 - i)) for q, name in ((1, "x"), (2, "bad")) for i in range(6)] + [(1, "x", 9, None, 0.1)]
    c = spark.createDataFrame(rows, "query_id long, query string, id long, text string, score double")
    pick = lambda df: {(r["query_id"], r["rank"]): r["id"] for r in df.collect()}
    assert pick(models.reranked(c, down, 2, rows=4, wait=0.0)) == {(1, 1): 5, (1, 2): 4, (2, 1): 0, (2, 2): 1}
    assert pick(models.reranked(c, down, 1, available=lambda: False)) == {(1, 1): 0, (2, 1): 0}
    assert models.reranked(c.limit(0), down, 2).count() == 0


def test_cells_compare_less_and_find_the_same(spark, tmp_path):
    """Clustered vectors, ties, zero and null vectors and queries, another length: the rows of the plain search, from a part of the products."""
    import numpy as np

    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 8))
    v = [(i, (hubs[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(600)]
    v += [(600, [0.0] * 8), (601, None), (602, [1.0]), (603, v[0][1]), (604, v[0][1])]
    vs = spark.createDataFrame(v, "id long, embedding array<double>").repartition(3)
    qs = spark.createDataFrame([(i, v[i][1]) for i in range(0, 600, 50)] + [(1000, [0.0] * 8)], "query_id long, vector array<double>")
    index = cells.Cells(Store(spark, str(tmp_path))).build(vs)
    out, pairs = index.search(qs, 7)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(out) == rows(vectors.top_k(qs, vs, 7))
    by = {r["query_id"]: r["n"] for r in pairs.groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    assert by.pop(1000) == 603 and max(by.values()) < 250
    assert cells.Cells(Store(spark, str(tmp_path / "none"))).build(vs.limit(0)).search(qs, 3)[0].count() == 0


def test_a_registered_parser_goes_first(spark):
    """A parser of one's own for a new language, and in place of one that is there."""
    files_ = spark.createDataFrame([(1, "a.props", "props", False, "a=1\n\nb=2"), (2, "b.csv", "csv", False, "id,name\n1,x")], "id long, path string, language string, is_binary boolean, content string")
    assert {(r["id"], r["type"]) for r in parsers.parse(files_).collect()} == {(1, "unknown"), (2, "data")}
    parsers.register(("props", "csv"), "config", parsers.blank_line_blocks)
    try:
        assert [(r["id"], r["type"], r["title"]) for r in parsers.parse(files_).orderBy("id", "pos").collect()] == [(1, "config", "block_0"), (1, "config", "block_1"), (2, "config", "block_0")]
    finally:
        parsers.PARSERS.pop(0)
