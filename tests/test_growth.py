"""Queries against their SQL on small odd tables, and what must not grow with a table."""

import duckdb

import __spark_entry__
from quarry.operators import chunking, graph, lexical, vectors
from quarry.plans.stored import Hashing
from quarry.sources.store import Store
from pyspark.sql import functions as F


def same_as_sql(spark, path, name, **tables):
    """Whether a query and its SQL give the same rows over these tables (a DataFrame each)."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(path))
    con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, got.collect()), key=key) == sorted(con.fetchall(), key=key)


def test_embed_dedup_hashes_terms_once_and_knows_null(spark, tmp_path):
    rows = [(1, "one two two Three é"), (2, "one two two Three é"), (3, ""), (4, None), (5, "--"), (6, "日本 語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = docs.select("doc_id", vectors.hash_embedding(lexical.terms_of(F.col("text")), 8).alias("e"))
    got = dict(map(tuple, out.collect()))
    want = Hashing(8)
    want.calls = 1
    assert got == dict(zip([r[0] for r in rows], want([r[1] or "" for r in rows])))
    assert same_as_sql(spark, tmp_path, "embed_dedup", documents=docs)
    # Hashes in nested lambdas were evaluated for every position of the vector, and again for the norm.
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rerank_scored_counts_bytes(spark, tmp_path):
    rows = [(0, "été à la thé way"), (50, "Wége"), (51, "a path"), (100, "日 path")]
    assert same_as_sql(spark, tmp_path, "rerank_scored", benchmark=spark.createDataFrame(rows, "item_id long, text string"))


def test_rerank_scored_reads_every_item_and_its_whole_text(spark, tmp_path):
    """Items that differ only beyond their first 20 characters differ in their scores; a null text has ranks, but no score; a null id is a query too."""
    long = "the way that we go by "
    rows = [(0, long), (7, long + "x" * 5000), (49, ""), (50, None), (51, "a path"), (53, "é" * 3000 + "Wege"), (None, "el camino es"), (-3, long + "日本")]
    assert same_as_sql(spark, tmp_path, "rerank_scored", benchmark=spark.createDataFrame(rows, "item_id long, text string"))
    got = __spark_entry__.queries()["rerank_scored"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(rows) and {r["query_id"] for r in got} == {r[0] for r in rows}
    assert {r["query_id"]: r["rerank_score"] for r in got if r["rank"] == 1} == {0: -15, 7: -5015, 49: -4, 50: None, 51: 0, 53: -6000, None: -3, -3: -21}


def test_shortest_paths_walk_from_sources_not_pairs(spark):
    """Two roots, four hubs each, leaves on one hub each: what is held follows the leaves, not pairs times leaves."""
    n = 400
    rows = [(f"r{k}", f"h{k}{j}") for k in range(2) for j in range(4)] + [(f"h{i % 2}{i % 4}", f"c{i}") for i in range(n)] + [("h00", f"d{i}") for i in range(n)]
    rows += [("r0", "x"), ("a", "r0"), ("c2", "a")]
    pairs = [(f"r{i % 2}", f"c{i}") for i in range(n)] + [("r0", "r0"), ("r0", "gone"), ("c2", "c0"), ("c2", "h00"), ("r1", "d1")]
    held = []

    def keep(df):
        held.append(df.count())
        return df

    e = spark.createDataFrame(rows, "source_id string, target_id string")
    got = {(r["source_id"], r["target_id"]): r["path"] for r in graph.shortest_paths(e, spark.createDataFrame(pairs, "source_id string, target_id string"), keep=keep).collect()}
    want = {(f"r{i % 2}", f"c{i}"): [f"r{i % 2}", f"h{i % 2}{i % 4}", f"c{i}"] for i in range(n)} | {("r0", "r0"): ["r0"], ("c2", "c0"): ["c2", "a", "r0", "h00", "c0"], ("c2", "h00"): ["c2", "a", "r0", "h00"]}
    assert got == want
    assert sum(held) < 8 * (len(rows) + len(pairs))


def test_equal_questions_are_scored_once(spark, tmp_path):
    """Fifty queries with two sets of terms: what is scored is two sets' documents, not fifty queries'."""
    docs = spark.createDataFrame([(i, "the way " * (i % 3) + "here") for i in range(200)], "id long, text string")
    asked = spark.createDataFrame([(q, ["the", "here"] if q % 2 else ["here", "way", "way"]) for q in range(50)] + [(50, []), (51, ["none"])], "query_id long, terms array<string>")
    index = lexical.Index(Store(spark, f"file://{tmp_path}/s")).write(docs)
    got = index.search(asked, 5)
    by_query = {}
    for r in got.collect():
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert sorted(by_query) == list(range(50)) and all(len(x) == 5 for x in by_query.values())
    for q in (0, 1):
        own = sorted(map(tuple, index.search(asked.where(F.col("query_id") == q), 5).select("rank", "id", "score").collect()))
        assert all(sorted(by_query[k]) == own for k in range(q, 50, 2))
    # Without a limit every query has its rows, but the sums that they come from are made once for each set.
    every = index.search(asked)
    rows = every.count()
    assert rows == 50 * 200
    assert every.drop("query_id").distinct().count() < rows and most_summed(every) == 2 * 200


def most_summed(df):
    """The most rows that an aggregate of a plan that has run gave for a query (or set) and id."""
    df.collect()
    found = []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name.endswith("HashAggregate") or name.endswith("SortAggregate"):
            if "sum(part" in p.simpleString(1000) and "partial_" not in p.simpleString(1000):
                found.append(p.metrics().get("numOutputRows").get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def test_sums_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SUMS", 20, raising=False)
    docs = spark.createDataFrame([(i, "the way here") for i in range(200)], "id long, text string")
    asked = spark.createDataFrame([(0, ["the"]), (1, ["way"])], "query_id long, terms array<string>")
    out = lexical.Index(Store(spark, f"file://{tmp_path}/s")).write(docs).search(asked, 5)
    assert out.count() == 10 and "hashpartitioning(id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan


def test_large_buckets_are_split(spark, tmp_path):
    """All rows have one key: they lie in one bucket, written by several tasks."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "20k")
    try:
        store = Store(spark, f"file://{tmp_path}/s")
        rows = spark.range(40_000, numPartitions=8).select(F.lit("k").alias("term"), F.xxhash64("id").alias("x"))
        store.commit(lambda c: c.append("t", rows, by=["term"], sort=["term"]))
        files = store.read("t").inputFiles()
        assert len(files) > 2 and len({f.rsplit("/", 1)[0] for f in files}) == 1
        assert store.read("t").distinct().count() == 40_000
    finally:
        spark.conf.set(name, old)


def test_paragraph_sizes_are_not_computed_inside_the_fold(spark):
    s = spark.createDataFrame([(1, "documentation", 0, "T", 1, "\n\n".join("w" * (i % 90) for i in range(400)))], "document_id long, type string, pos int, title string, level int, content string")
    out = chunking.section_chunks(s)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "get(" not in plan and "[namedlambdavariable" not in plan.lower().replace("get(", "[")
    assert sum(len(r["content"].replace("\n", "")) for r in out.collect()) == sum(i % 90 for i in range(400))


def test_chunks_are_numbered_without_a_shuffle(spark):
    d = spark.createDataFrame([(1, "\n".join("line %d of a text that is cut" % i for i in range(900))), (2, None), (3, "short")], "document_id long, content string")
    out = chunking.line_blocks(d)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    own = out.where("document_id = 1").orderBy("end_line").collect()
    assert [r["idx"] for r in own] == list(range(len(own))) and len(own) > 3 and out.where("document_id > 1").count() == 0


def shuffled_rows(df):
    """The rows that the exchanges of a plan write."""
    df.collect()
    total = 0

    def walk(p):
        nonlocal total
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name == "Exchange":
            total += p.metrics().get("shuffleRecordsWritten").get().value()
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_cells_do_not_copy_vectors_for_each_cell(spark, tmp_path, monkeypatch):
    """Vectors without clusters, so nearly all cells are compared: each vector goes to each block of queries once."""
    import numpy as np

    from quarry.operators import cells

    monkeypatch.setattr(vectors, "QUERY_ROWS", 5)
    x = np.random.default_rng(5).normal(size=(2000, 6))
    vs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [0.0] * 6) for i in range(3)], "id long, embedding array<double>").repartition(3)
    qs = vs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = cells.Cells(Store(spark, f"file://{tmp_path}/s")).build(vs)
    out, pairs = index.search(qs, 7)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(out) == rows(vectors.top_k(qs, vs, 7)) and len(rows(out)) == 7 * qs.count()
    assert pairs.count() == pairs.select("query_id", "cell").distinct().count()
    assert shuffled_rows(out) < 20 * 2000


def test_a_value_has_blocks_of_its_own(spark, monkeypatch):
    """Two hundred values with three vectors and two queries each: no vector is copied for other values' queries. A null value is one too."""
    monkeypatch.setattr(vectors, "QUERY_ROWS", 5)
    v = spark.createDataFrame([(i, [1.0, float(i)], None if i % 200 == 7 else i % 200) for i in range(600)], "id long, embedding array<double>, g int")
    q = v.where("id < 400").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), "g")
    out = vectors.top_k(q, v, 2, by="g")
    got = out.groupBy("query_id").agg(F.sum((F.col("id") % 200 == F.col("query_id") % 200).cast("int")).alias("n")).collect()
    assert len(got) == 400 and all(r["n"] == 2 for r in got)
    assert shuffled_rows(out) < 4000


def test_an_index_shuffles_blocks_of_postings(spark, tmp_path):
    """What is written and shuffled follows terms, not the uses of terms in documents; odd texts, and ids that are there twice though called unique."""
    docs = spark.createDataFrame([(i, f"the way the {'x' * (i % 9)} é{i % 5} 日本") for i in range(3000)] + [(5000, None), (5001, ""), (5002, "--")], "id long, text string").repartition(4)
    store = Store(spark, f"file://{tmp_path}/s")
    index = lexical.Index(store).write(docs, unique=True)
    want = {r["term"]: r["df"] for r in lexical.postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    assert {r["term"]: r["df"] for r in index.dictionary().collect()} == want and len(want) == 16
    assert store.read("fts-postings").where("term IS NOT NULL").count() <= 4 * len(want)
    assert sorted(map(tuple, store.read("fts-lengths").select("id", "n").collect())) == sorted(map(tuple, lexical.lengths(docs).collect()))
    assert sorted(map(tuple, lexical.flat(store.read("fts-postings")).where("term IS NOT NULL").select("term", "id", "tf").collect())) == sorted(map(tuple, lexical.postings(docs).collect()))
    again = docs.unionByName(docs.where("id < 10"))
    twice = lexical.Index(store, "twice").write(again, unique=True)
    assert {r["term"]: r["df"] for r in twice.dictionary().collect()} == want
    assert lexical.flat(store.read("twice-postings")).where("term = 'the' AND id < 11").groupBy("tf").count().orderBy("tf").collect() == [(2, 1), (4, 10)]
    index.delete(docs.where("id % 2 = 0").select("id")).merge()
    assert {r["term"]: r["df"] for r in index.dictionary().collect()}["the"] == 1500 and store.read("fts-lengths").count() == 1501
    assert store.read("fts-postings").where("term IS NOT NULL").count() <= 32 * len(want)


def test_stems_are_summed_with_few_and_many_terms(spark, tmp_path, monkeypatch):
    """Several terms of a document answer to one asked; numbers of documents are broadcast only if few terms are asked for."""
    docs = spark.createDataFrame([(i, "run running runs " + "cat cats " * (i % 3)) for i in range(300)], "id long, text string")
    asked = spark.createDataFrame([(0, ["runs", "cat"]), (1, ["cats"])], "query_id long, terms array<string>")
    index = lexical.Index(Store(spark, f"file://{tmp_path}/s"), stemmed=True).write(docs, unique=True)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    got = index.search(asked, 5, "stem")
    own = rows(got)
    assert len(own) == 10 and got.where("query_id = 1").agg(F.count_distinct("score")).first()[0] == 1
    monkeypatch.setattr(lexical, "FEW_TERMS", 0)
    assert rows(index.search(asked, 5, "stem")) == own
