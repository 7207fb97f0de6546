import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, fuse

SCHEMA = "doc_id long, text string, digest string, n long"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 500, 20_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = fuse.build(keys)
    assert fuse.contains(keys, *f).all()
    assert fuse.contains(rng.integers(0, 2**63, 50_000).astype(np.uint64) | np.uint64(1 << 63), *f).mean() < 0.001


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = min(real) if real else None
        out += [(i, keep, len(ids), sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def rows_for(rnd):
    texts = ["a b", "a  b", "a\tb", "a b ", None, "", " ", "é", "long " * 5000] + [f"t{rnd.randint(0, 30)}" for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "only null"), (None, "only null"), (3, "a b "), (3, "a b ")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, weak):
    rows = rows_for(random.Random(8))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    # With a digest of one digit, different texts meet in one bucket, and only the byte checks tell them apart.
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    if weak:
        digest = lambda c: F.rpad(F.substring(F.sha2(c, 256), 1, 1), 64, "0")
    half = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    out = exact_dedup.exact_dedup(df.where(half), df.where(~half), digest=digest).collect()
    want = brute(rows)
    if weak:
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=repr) == sorted((w[:3] for w in want), key=repr)
    else:
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr) == want
        kept = [(r["text_sha256"]) for r in out if r["kept"]]
        assert len(kept) == len(set(kept)) == len({w[3] for w in want})


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "a", "", 1), (2, "a", "", 1)], SCHEMA)
    for a, b in ((df, df.limit(0)), (df.limit(0), df)):
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(a, b).collect()) == [(1, 1, 2), (2, 1, 2)]
    assert exact_dedup.exact_dedup(df.limit(0), df.limit(0)).count() == 0


def test_two_batches_read_one_stored_index(spark, monkeypatch):
    """The second batch builds no filter: the index is built once, and results are those of all rows at once."""
    built = []
    own = exact_dedup.build_filters
    monkeypatch.setattr(exact_dedup, "build_filters", lambda groups: built.append(1) or own(groups))
    rows = rows_for(random.Random(9))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    part = F.coalesce(F.col("doc_id"), F.lit(0)) % 4
    out = exact_dedup.exact_dedup(df.where(part == 0), [df.where(part == 1), df.where(part > 1)]).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr) == brute(rows) and built == [1]
    name = {sha256(str(i).encode()).hexdigest(): i for i in range(200)}
    of = {i: d for d, i in name.items()}
    digests = spark.createDataFrame([(i, i, of[i]) for i in range(50)], "rid long, doc_id long, digest string")
    index = exact_dedup.build_index(digests)
    for low in (0, 40):
        batch = spark.createDataFrame([(i, i, of[i]) for i in range(low, low + 100)], digests.schema)
        maybe = {name[r["digest"]] for r in exact_dedup.screen(index, batch).where("maybe").collect()}
        assert set(range(low, 50)) <= maybe and len(maybe) <= 50 - low + 3
    assert built == [1, 1]
