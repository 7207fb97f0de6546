import random
import re

from quarry.llm import secret_scan

SCHEMA = "doc_id long, text string, rid string, row string, spans string, kind string"
KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
HEX = "0123456789abcdef" * 2


def brute(text):
    """All spans of a text by plain Python: (start, place, end, kind)."""
    t, found = text or "", []
    kinds = (*secret_scan.BASE, *secret_scan.WEAK)
    for place, k in enumerate(kinds, 1):
        found += [(m.start(), place, m.end(), k) for m in re.finditer(k.pattern, t) if len(m.group(k.group)) >= k.least]
    gaps = [m.start() for m in re.finditer(secret_scan.GAP.pattern, t)]
    block = lambda s: sum(g < s for g in gaps)
    out = []
    for s, place, e, k in found:
        roles = {o.role for q, _, _, o in found if block(q) == block(s) and abs(q - s) <= secret_scan.REACH}
        if k in secret_scan.BASE or all(roles & need for need in secret_scan.COMPLETE[k.name]):
            out.append((s, place, e, k.name))
    return sorted(out)


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "r", "w", "s", "k") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["rid"], [tuple(s) for s in r["spans"]]) for r in secret_scan.scanned(df).select("row.doc_id", "row.rid", "spans").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == ("r", brute(t)), (i, t)
    return {i: [s[3] for s in v[1]] for i, v in got.items()}


def test_base_spans(spark):
    kinds = check(spark, [
        None, "", "nothing here", "password = hunter22", "PassWord:'abcdef'", "token=abc", "token=token: abcdefgh", "api_key==x1234567", "apikey: 'q" + "w" * 40 + "'",
        KEY, KEY[:19], "x" + KEY + "é", HEX[:24], HEX[:23], "ABCDEF" * 8, f"é🙂 token = \"{HEX}\" and {HEX}", "a" * 5000, "token = " * 300,
    ])
    assert kinds[3] == ["assign"] and kinds[5] == [] and kinds[6] == [] and kinds[9] == ["access"] and kinds[15] == ["assign", "hex", "hex"]


def test_weak_parts_need_their_complements(spark):
    far = " word" * 80
    kinds = check(spark, [
        "user: bob99", "mail bob@example.com", "pwd: s3cr3t", "10.0.0.1", "https://db.example.com/x", "pwd: s3cr3t at 10.0.0.1", "user: bob99\npwd: s3cr3t", "user: bob99\n\npwd: s3cr3t",
        "user: bob99" + far + "pwd: s3cr3t", "user=bob99 pwd=s3cr3t host=db.local", f"bob@example.com {HEX}", f"{KEY} bearer abcdefghijk", "user: a1b\n \t\npassword=hunter22",
    ])
    assert [kinds[i] for i in range(5)] == [[]] * 5
    assert kinds[5] == ["pass"] and kinds[6] == ["user", "pass"] and kinds[7] == kinds[8] == [] and kinds[9] == ["user", "pass", "endpoint"]
    assert kinds[10] == ["user", "hex"] and kinds[11] == ["access", "pass"] and kinds[12] == ["assign"]


def test_many_parts_in_one_scope(spark):
    rnd = random.Random(4)
    bits = ["user: bob{}", "pwd: x{}y{}", "10.0.0.{}", HEX + "{}", "\n\n", " filler words {}", "https://h{}.example.org/a", "token: t{}aaaaaa", "ab@c{}.de"]
    texts = [" ".join(rnd.choice(bits).format(rnd.randrange(100), 1) + " x" * rnd.randrange(60) for _ in range(150)) for _ in range(6)]
    check(spark, texts)


def test_empty_and_plan(spark):
    assert secret_scan.scanned(spark.createDataFrame([], SCHEMA)).count() == 0
    df = secret_scan.parts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
