import decimal
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality_knn, toxicity

D = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, toxic int, quality int, score double"


def accuracy(spark, df, label):
    rows = df.join(spark.read.parquet(f"{D}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").collect()
    hit = {y: [r["predicted"] == y for r in rows if r[label] == y] for y in (0, 1)}
    return {y: sum(h) / max(1, len(h)) for y, h in hit.items()}


def test_quality_held_out(spark):
    got = quality_knn.op1_quality_knn(spark, D)
    assert got.count() == spark.read.parquet(f"{D}/documents.parquet").count()
    acc = accuracy(spark, got, "quality")
    assert acc[0] > 0.9 and acc[1] > 0.97


def test_toxicity_held_out(spark):
    got = toxicity.op8_toxicity(spark, D)
    assert got.count() == spark.read.parquet(f"{D}/documents.parquet").count()
    acc = accuracy(spark, got, "toxic")
    # 37 toxic documents to learn from, in four languages.
    assert acc[0] > 0.95 and acc[1] > 0.5


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then what lies left and right of it."""
    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 1e-12 and (top is None or s > top[0] + 1e-12):
                    top = (s, i, j)
        return [] if top is None else best(a, top[1]) + [top] + best(top[2] + 1, b)

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_the_maximal_ones(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 40)
    hits = {i: rnd.uniform(0.1, 3) for i in range(n) if rnd.random() < 0.3}
    got = toxicity.segments(sorted(hits.items()), drift=0.5)
    want = brute_segments([hits.get(i, -0.5) for i in range(n)])
    assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in want]


def test_all_passages_of_a_long_text_count():
    model = toxicity.Model({}, 0.1)  # lam = k = 1: of 15,000 clean tokens, 15 segments of this score are expected
    at = math.log(1000)
    assert toxicity.p_value(15_000, [(at, 0, 0)] * 20, model) == 1.0
    assert toxicity.p_value(15_000, [(at, 0, 0)] * 60, model) == pytest.approx(6.5495e-15, rel=1e-3)
    assert toxicity.p_value(15_000, [(at, 0, 0)] * 100_000, model) < 1e-300


def test_a_repeated_passage_counts_each_time():
    model = toxicity.Model({"vilex": 6.0, "nastyx": 6.0}, 0.1)
    rest = ["word"] * 900
    text = " ".join([*rest, "vilex", "and", "nastyx", *rest, "vilex", "and", "nastyx", *rest])
    scores, (spans,) = toxicity._judged(pa.array([text]), model)
    assert [(x["first"], x["last"]) for x in spans.as_py()] == [(900, 902), (1803, 1805)]
    assert {round(x["score"], 6) for x in spans.as_py()} == {12 - toxicity.DRIFT}
    once, _ = toxicity._judged(pa.array([" ".join([*rest, "vilex", "and", "nastyx", *rest, *rest])]), model)
    assert scores[0].as_py() > once[0].as_py()


@pytest.mark.parametrize("mean,r", [(0.5, 1), (0.01, 3), (15, 20), (15, 60), (900, 1000)])
def test_poisson_tail(mean, r):
    with decimal.localcontext() as c:
        c.prec = 60
        m = decimal.Decimal(mean)
        below = sum((-m).exp() * m**i / math.factorial(i) for i in range(r))
        assert toxicity._tail(mean, r) == pytest.approx(float(1 - below), rel=1e-9)


def planted(rnd, bad):
    words = [rnd.choice("one two three four five six seven eight nine ten".split()) + rnd.choice("abcdefgh") for _ in range(60)]
    if bad:
        at = rnd.randrange(50)
        words[at : at + 3] = ["vilex,", "AND", "nastyx!"]
    return " ".join(words)


def test_planted_passages(spark):
    rnd = random.Random(3)
    rows = [(i, planted(rnd, i % 3 == 0), int(i % 3 == 0), None, 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(df)
    test = [(1000 + i, planted(rnd, i % 2 == 0), None, None, 0.1) for i in range(60)] + [(1, None, None, None, None), (None, "", None, None, None), (None, "x " * 50_000, None, None, None)]
    new = spark.createDataFrame(test, SCHEMA)
    got = toxicity.scored(new, model).collect()
    assert len(got) == len(test)
    for r in got:
        bad = r["doc_id"] is not None and r["doc_id"] >= 1000 and r["doc_id"] % 2 == 0
        assert (r["score"] >= 0.3) == bad and 0 <= r["score"] <= 1 and bool(r["passages"]) >= bad
    kept = toxicity.accepted(new, model)
    assert kept.columns == new.columns and kept.count() == len(test) - 30


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b", 0, 1, 0.0), (2, None, 0, 1, 0.0), (2, None, None, 1, 0.0)], SCHEMA)
    for part in (df, df.limit(0)):
        rows = toxicity.scored(df, toxicity.fit(part)).collect()
        assert len(rows) == 3 and all(r["score"] < 0.3 for r in rows)
        scores = quality_knn.scored(df, quality_knn.fit(part.select("doc_id", "text", "quality"))).collect()
        assert len(scores) == 3 and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.scored(df.limit(0), toxicity.fit(df)).count() == 0


def test_vote_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(size=(50, 6)).astype(np.float32)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    votes = np.where(np.arange(50) % 4 == 0, -2.0, 0.7).astype(np.float32)
    m = quality_knn.Model(np.zeros(6, np.float32), np.eye(6, dtype=np.float32), z, votes, 0.5)
    x = rng.normal(size=(20, 6)).astype(np.float32)
    for row, got in zip(x, quality_knn.vote(x, m, k=7)):
        sims = sorted(((float(row @ v / np.linalg.norm(row)), float(w)) for v, w in zip(z, votes)), reverse=True)[:7]
        w = [(np.exp(quality_knn.SHARPNESS * s) * abs(v), v > 0) for s, v in sims]
        assert abs(got - sum(a for a, up in w if up) / sum(a for a, _ in w)) < 1e-4


@pytest.mark.parametrize("seed", range(10))
def test_segments_of_falling_totals(seed):
    rnd = random.Random(100 + seed)
    hits = [(8 * i, rnd.choice((0.5, 0.6, 1.1, 2.0))) for i in range(8)]
    want = brute_segments([dict(hits).get(i, -0.15) for i in range(60)])
    assert [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits)] == [(round(s, 6), a, b) for s, a, b in want]


def test_segments_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        assert len(toxicity.segments([(8 * i, 1.0 - 1e-7 * i) for i in range(n)])) == n
        return time.perf_counter() - began

    took(1000)
    assert took(160_000) < 40 * max(took(16_000), 1e-3)


def test_words_share_their_beginnings(spark):
    """A made-up language: no toxic word of the new texts occurs among the labelled ones, but its beginning does; an innocent word shares another's beginning."""
    rnd = random.Random(5)
    ends = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]

    def text(bad, own):
        words = [rnd.choice(ends) + rnd.choice(ends) for _ in range(120)]
        words[7] = "wortel"  # shares four letters with a toxic word
        for at in rnd.sample(range(10, 120), 3 * bad):
            words[at] = rnd.choice(["zzyxo" + rnd.choice(own), "worthless"])
        return " ".join(words)

    train = spark.createDataFrame([(i, text(i % 4 == 0, ends[:75]), int(i % 4 == 0)) for i in range(400)], "doc_id long, text string, toxic int")
    model = toxicity.fit(train)
    assert "worthless" in model.weights and any("zzyxo".startswith(s) for s in model.starts) and model.seen["wortel"] is None
    new = spark.createDataFrame([(i, text(i % 2 == 0, ends[75:])) for i in range(200)], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.scored(new, model).where("score < 0.3").orderBy("doc_id").collect()] == list(range(1, 200, 2))


def test_copies_count_once_and_hot_ids_are_bounded(spark):
    rows = [(i, planted(random.Random(i), False)) for i in range(100)]
    docs = spark.createDataFrame(rows + [(7, f"text {k}") for k in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(100)] + [(7, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, rows=40)
    assert rows.count() == rows.select("doc_id").distinct().count() <= 41
    assert {r["toxic"] for r in rows.where("doc_id = 7").collect()} <= {1}
    # One clean text many times over, that a label calls toxic: its words get no weight.
    copies = spark.createDataFrame([(i, "alpha beta gamma delta epsilon " * 3, 1) for i in range(300)] + [(1000 + i, planted(random.Random(i), False), 0) for i in range(300)], "doc_id long, text string, toxic int")
    assert not toxicity.fit(copies).weights


def test_toxicity_end_to_end_against_plain_python(spark):
    """Scores, passages and kept rows of a whole table, against the definition of each step in plain Python."""
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(toxicity.training_rows(docs, labels))
    got = {r["doc_id"]: r for r in toxicity.scored(docs, m).collect()}
    assert len(got) == docs.count() and m.weights and m.drift > 0
    for r in docs.where("length(text) < 1500").orderBy("doc_id").limit(150).collect():
        words = toxicity.TOKEN.findall(r["text"].lower())
        own = [max((w for f, w in [*((x, y) for x, y in m.weights.items() if x == t), *((x, y) for x, y in m.starts.items() if t != x and t.startswith(x) and len(x) in toxicity.BEGINNINGS)]), default=None) for t in words]
        want = brute_segments([-m.drift if w is None else w for w in own])
        p = 1.0
        for k, s in enumerate(sorted((s for s, _, _ in want), reverse=True), 1):
            mean = m.k * len(words) * math.exp(-m.lam * s)
            if mean < k:
                p = min(p, k * (k + 1) * (1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))))
        x = m.shift - m.slope * math.log(max(p, 1e-13))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-x)), rel=0.02, abs=1e-4)
        spans = [(a, b) for s, a, b in want if m.k * max(len(words), 1) * math.exp(-m.lam * s) <= toxicity.SIGNIFICANT]
        assert [(q["first"], q["last"]) for q in got[r["doc_id"]]["passages"]] == spans


def test_quality_end_to_end_against_plain_python(spark):
    """Features, axes and votes of a whole table, each by its definition."""
    import numpy as np

    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    known = quality_knn.of_sample(docs, quality_knn.sample(labels, "quality"), "quality")
    m = quality_knn.fit(known)

    def plain(text):
        raw = text.encode()
        out = np.zeros(quality_knn.BUCKETS + quality_knn.EXTRA)
        low = raw.lower()
        for i in range(len(low) - 2):
            out[((low[i] << 16 ^ low[i + 1] << 8 ^ low[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 21] += 1
        out = np.log1p(out)
        out /= np.linalg.norm(out) or 1
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n, size = max(len(words), 1), len(raw)
        out[quality_knn.BUCKETS :] = (
            len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(65 <= c <= 90 for c in raw) / size, len(set(lines)) / max(len(lines), 1),
            sum(c in b"#*$%&|<>!{}[]=~^" for c in raw) / size, math.log1p(n) / 10, min(1.0, size / n / 20), sum(48 <= c <= 57 for c in raw) / size,
        )
        return out

    rows = known.orderBy("doc_id").collect()
    x, y = np.stack([plain(r["text"]) for r in rows]), np.array([r["quality"] for r in rows])
    spread = np.concatenate([np.ones(quality_knn.BUCKETS), 1 / (x[:, quality_knn.BUCKETS :].std(axis=0) + 0.05) / 4])
    _, _, axes = np.linalg.svd((x - x.mean(axis=0)) * spread, full_matrices=False)
    axes = (axes[: quality_knn.RANK] * spread).T
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    z, weight = unit((x - x.mean(axis=0)) @ axes), np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    some = docs.where("text <> ''").orderBy("doc_id").limit(200).collect()
    got = {r["doc_id"]: r["score"] for r in quality_knn.scored(docs, m).collect()}
    near = unit((np.stack([plain(r["text"]) for r in some]) - x.mean(axis=0)) @ axes) @ z.T
    for r, s in zip(some, near):
        best = np.argsort(-s)[: quality_knn.NEIGHBOURS]
        w = np.exp(quality_knn.SHARPNESS * s[best]) * weight[best]
        assert got[r["doc_id"]] == pytest.approx(w[y[best] == 1].sum() / w.sum(), abs=5e-3)


def test_quality_ties_and_bounds(spark):
    import numpy as np

    z = np.eye(2, dtype=np.float32)[[0, 0, 0, 1]]
    m = quality_knn.Model(np.zeros(2, np.float32), np.eye(2, dtype=np.float32), z, np.array([1, -1, -1, 1], np.float32), 0.5)
    assert quality_knn.vote(np.array([[2.0, 0.0]], np.float32), m, k=1)[0] == pytest.approx(1 / 3)  # all three at the same distance count
    docs = spark.createDataFrame([(1, "a")] * 3000 + [(1, "b"), (2, "c " * 100_000), (3, None)], "doc_id long, text string")
    known = quality_knn.of_sample(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int"), "quality")
    assert known.count() == 3
    scores = quality_knn.scored(docs, quality_knn.fit(known)).collect()
    assert len(scores) == 3003 and all(0 <= r["score"] <= 1 for r in scores)
    assert quality_knn.scored(docs.limit(0), quality_knn.fit(known)).count() == 0


def test_votes_do_not_depend_on_the_block(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = quality_knn.fit(quality_knn.of_sample(docs, quality_knn.sample(labels, "quality"), "quality"))
    x = np.stack([quality_knn.features(r["text"]) for r in docs.collect()])
    whole = quality_knn.vote(x, model)
    assert (whole == np.concatenate([quality_knn.vote(x[i : i + 1], model) for i in range(len(x))])).all()
    assert (whole == np.concatenate([quality_knn.vote(x[i : i + 7], model) for i in range(0, len(x), 7)])).all()
