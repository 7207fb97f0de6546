import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import fill_middle

SCHEMA = "doc_id long, text string, n long, form string, units string, h string, row string, output string"
TEXTS = [None, "", "a", "ab\ncd\r\n", "é🙂é x", "has <P> inside", "<S>", "ends <", "<M", "P><S", "x" * 50_000, "same", "same", "\u0000 y"]


def brute(doc_id, text, rate=90, spm=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_python_with_clashing_columns(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], 7, "f", "u", "h", "r", "o") for i in range(200)] + [(None, "no id", 7, "f", "u", "h", "r", "o")]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    got = out.select("row.doc_id", F.col("row.text").alias("text"), F.col("row.n").alias("own"), "n", "form", F.length("prefix").alias("p"), F.length("middle").alias("m"), "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["p"], r["m"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["own"] == 7


def test_other_units_and_sentinels(spark):
    df = spark.createDataFrame([(i, "one two  three\n four.five" * (i % 4)) for i in range(40)], "doc_id long, text string")
    marks = ("<|a|>", "<|b|>", "<|c|>")
    out = fill_middle.fill_in_middle(df, 100, 50, unit=r"(?s)\S+|\s+", sentinels=marks)
    for r in out.select("row.text", "form", "n", "prefix", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("back")).collect():
        assert r["back"] == r["text"] and (r["form"] == "plain") == (r["text"] == "")
        assert r["prefix"] is None or r["prefix"] == "" or r["text"].startswith(r["prefix"])
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(df, sentinels=("<", "<S>", "<M>"))


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_projection(spark):
    df = fill_middle.fill_in_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
