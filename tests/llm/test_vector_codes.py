import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import vector_codes

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, x binary"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label). Plain Lloyd in Python integers: {(vec_id, vector): (code, error)}, sums by label, codebooks."""
    kept = [(i, tuple(math.floor(4096 * x) for x in v), y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    order = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(first[i], p) for i in order] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda j: (d(cut(v, p), books[p][j]), j)) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == j]
                if own:
                    books[p][j] = tuple(sum(x) // len(own) for x in zip(*own))
    out, by = [], {}
    for (i, v, y), c in zip(kept, assign()):
        e = sum(d(cut(v, p), books[p][c[p]]) for p in range(parts))
        by[y] = by.get(y, 0) + e
        out.append((i, "".join(f"{x:02x}" for x in c), e, y))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[y], sha) for i, c, e, y in out), key=str)


def got(df, **kw):
    coded, books = vector_codes.compressed(df, **kw)
    rows = vector_codes.with_label_error(coded).collect()
    return sorted(((r["id"], r["code"].hex(), r["error"], r["label_error"], books.sha256()) for r in rows), key=str)


def test_documented_table(spark):
    df = vector_codes.op11_vector_codes(spark, D)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    assert sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute(rows)


def test_ties_nulls_repeats_and_clashing_columns(spark):
    rnd = random.Random(3)
    grid = lambda: [rnd.choice((-1.0, -0.5, 0.0, 0.25, 0.5)) for _ in range(16)]  # noqa: E731  (a coarse grid: many equal distances)
    rows = [(i, grid(), rnd.choice((1, 2, None))) for i in range(300)]
    rows += [rows[0], rows[0], (5, grid(), 1), (None, grid(), 2), (400, None, 1), (401, [], 1), (402, [None] * 16, 1), (403, [float("nan")] * 16, 2), (404, [math.inf] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "i", "c", b"x") for r in rows], SCHEMA).repartition(5)
    assert got(df) == brute(rows)
    few = spark.createDataFrame([(*r, "i", "c", b"x") for r in rows[:5]], SCHEMA)
    assert got(few, rounds=3) == brute(rows[:5], rounds=3)


def test_empty_and_refused(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1, "", "", b"")], SCHEMA)) == []
    bad = spark.createDataFrame([(1, [1.0] * 12, 1, "", "", b"")], SCHEMA)
    with pytest.raises(ValueError):
        vector_codes.compressed(bad)


def test_bounds_spare_comparisons_and_change_nothing():
    rnd = np.random.default_rng(7)
    x = (np.repeat(rnd.integers(-3000, 3000, (16, 8)), 200, axis=0) + rnd.integers(-200, 200, (3200, 8))).astype(np.int64)
    book = x[rnd.choice(len(x), 16, replace=False)]
    code, upper, lower = vector_codes.nearest(x, book)
    scans = 0
    for _ in range(6):
        new = np.array([x[code == j].sum(axis=0) // max(1, (code == j).sum()) if (code == j).any() else book[j] for j in range(16)])
        code, upper, lower, n = vector_codes.reassign(x, vector_codes.Moved.between(book, new), code, upper, lower)
        book, scans = new, scans + n
        assert (code == vector_codes.squared(x, book).argmin(axis=1)).all()
    assert scans < 0.5 * 6 * len(x)


def test_decoding(spark):
    rows = [(i, [i / 16, 0.5] * 8, 1, "", "", b"") for i in range(10)]
    coded, books = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA))
    for r in vector_codes.decoded(coded, books).collect():
        assert r["error"] == sum((math.floor(4096 * a) - b * 4096) ** 2 for a, b in zip([r["id"] / 16, 0.5] * 8, r["vector"])) == 0
