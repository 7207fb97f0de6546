import random

import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import components

SCHEMA = "doc_id long, text string, fp string, key string"


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(docs):
    fps = [brute(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)]


def got(df):
    out = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    return sorted((tuple(r) for r in out), key=repr)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(df) == sorted(roots(docs), key=repr)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    docs = [(5, None), (3, ""), (4, " \n"), (None, "a b c d e"), (9, "A b  C d e"), (8, "a\x85b c"), (7, "one"), (7, "one"), (1, long), (2, long + " more"), (None, "lone row here now")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    assert got(df) == sorted(roots(docs), key=repr)
    assert got(df.limit(0)) == []


def test_links_find_every_pair(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for d in (4, 2):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= d}
        rows = [tuple(r) for r in simhash.links(df, d).collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(60)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(up)}
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(rows) == len(want) and {r["u"]: r["root"] for r in rows} == want


def test_links_never_broadcast(spark):
    fps = spark.range(200_000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
