import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import exact_dedup, line_dedup, near_dedup, quality_rules, registry, toxicity

SCHEMA = "doc_id long, text string, no int, doc string, rank long"


def brute(rows, least):
    """Lines that lie in a run of at least ``least`` words with an equal run that begins earlier in the corpus."""
    docs = sorted({(i is None, i if i is not None else 0, t or "") for i, t in rows})
    seqs = []
    for none, i, t in docs:
        raw = t.split("\n")
        real = [k for k, x in enumerate(raw) if x.strip(" \t\n\x0b\x0c\r")]
        seqs.append((None if none else i, t, raw, real, [" ".join(raw[k].split()) for k in real]))
    seen, gone = set(), [set() for _ in seqs]
    for d, (_, _, _, _, lines) in enumerate(seqs):
        words = [len(x.split(" ")) for x in lines]
        here = []
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += words[b]
                if n >= least:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone[d] |= set(range(a, b + 1))
                    seen.add(run)
    out = {}
    for (i, t, raw, real, _), g in zip(seqs, gone):
        drop = {real[k] for k in g}
        out[i, t] = ("\n".join(x for k, x in enumerate(raw) if k not in drop), len(real), len(g))
    return sorted(((i, *(out[i, t or ""] if t is not None or out[i, ""][2] else (None, *out[i, ""][1:]))) for i, t in rows), key=repr)


def got(spark, rows, least):
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(df, least).select("row.doc_id", "text", "n_lines", "n_removed").collect()), key=repr)


def test_random_corpora(spark):
    rnd = random.Random(6)
    lines = ["a b c", "d e", "f", "g h i j k l", "", "  ", "a  b c ", "m n o p"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14)))) for i in range(50)]
    rows += [(None, None), (60, None), (61, ""), (None, "a b c\nd e\nf"), (3, rows[3][1]), (3, rows[3][1]), (70, rows[5][1])]
    for least in (6, 13):
        assert got(spark, rows, least) == brute(rows, least)


def test_deep_runs_and_long_texts(spark):
    passage = "\n".join(f"w{k}" for k in range(70))
    many = "\n".join(f"line {k} of many" for k in range(3000))
    rows = [(1, "x y\n" + passage + "\nz"), (2, "q\n" + passage), (3, many), (4, many), (5, "short\nwords")]
    out = {r[0]: r for r in got(spark, rows, 50)}
    assert out[1][3] == 0 and out[2][3] == 70 and out[2][1] == "q" and out[3][3] == 0 and out[4][3] == 3000 and out[4][1] == "" and out[5][3] == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_dedup(df).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = registry.QUERIES[name](spark, d)
    rel = c.sql(registry.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_pipeline_stage_by_stage(spark, tmp_path):
    from tests.llm.test_packing import check
    from tests.llm.test_rules_urls_shards import brute_rules
    from tests.llm.test_near_dedup import brute as near_brute

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = set(docs.columns)
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or set(docs.columns) == cols
        outs.append(docs)
    texts = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outs[:4]]
    model = toxicity.fit(toxicity.training_rows(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")))
    every = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert texts[0] == {i: t for i, t in every.items() if toxicity.score(*toxicity.scan(t, model), model) < toxicity.THRESHOLD}
    assert set(texts[1]) <= set(texts[0]) and all(not brute_rules(t)[5] for t in texts[1].values())
    lines = {i: t for i, t, _, _ in brute(list(texts[1].items()), line_dedup.MIN_WORDS)}
    assert texts[2] == lines
    assert sorted(texts[3]) == near_brute(list(texts[2].items()))
    check(outs[4].collect(), list(texts[3].items()))
    assert outs[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_one_of_each_with_nulls(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, "x", None), (2, "a b c d", 1, "x", None), (2, "a b c d", 1, "x", None), (None, "other words here now", 1, "x", None), (5, None, 1, "x", None), (6, "", 1, "x", None)], SCHEMA)
    out = near_dedup.one_of_each(df)
    assert out.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == [(2, "a b c d"), (5, None), (None, "other words here now")]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert quality_rules and exact_dedup


def test_stages_with_nulls_empty_tables_and_clashing_columns(spark, tmp_path):
    """Every stage on null texts and ids, repeated rows, a very long text, no rows at all, and columns named like its own."""
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, root long, at long, kept boolean, place long, words string, score double, gone long"
    good = " ".join(r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en' AND n_chars > 900").orderBy("doc_id").limit(3).collect())
    rest = ("en", "s", 1, "r", 2, 3, 4, True, 5, "w", 0.5, 6)
    rows = [(1, good, *rest), (1, good, *rest), (2, None, *rest), (None, good + " end", *rest), (None, None, *[None] * 12), (3, "", *rest), (4, (good + " ") * 40, *rest)]
    for k, table in enumerate((rows, [])):
        docs = spark.createDataFrame(table, schema)
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, d).write.parquet(str(tmp_path / f"{k}-{j}"))
            out = spark.read.parquet(str(tmp_path / f"{k}-{j}"))
            assert name == "packing" or out.columns == docs.columns
            assert not table or name != "toxicity" or out.count() == len(rows)
            docs = out if out.count() or not table else docs
        assert bool(table) == bool(docs.count())
