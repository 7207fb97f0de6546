import random

import numpy as np

import corpus_pipeline
from quarry.llm import near_dedup

D = "/root/testdata/sf0.001"


def brute(rows):
    """The rows that stay, by the plain definition: all pairs, exact Jaccard over five-word shingles."""
    sets = []
    for _, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def kept(df):
    return sorted(r["doc_id"] for r in corpus_pipeline.near(None, df, None).select("doc_id").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_and_chains(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(4000)}" for _ in range(200)]
        for c in range(6):  # each copy is an edit of the one before: ends of a chain are less similar than 0.8
            rows.append((g * 10 + c, " ".join(words)))
            words = list(words)
            for _ in range(3):
                words[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "a b c d e f"), (506, "f e d c b a")]
    rnd.shuffle(rows)
    assert kept(frame(spark, rows)) == brute(rows)


def test_documents(spark):
    df = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert kept(df) == brute(rows)


def test_empty(spark):
    assert corpus_pipeline.near(None, frame(spark, []), None).count() == 0


def test_no_link_is_lost_close_to_the_limit(spark):
    """400 pairs of similarity 0.80 to 0.82, which fingerprints would miss, and 100 pairs just below."""
    rnd, rows, want = random.Random(11), [], []
    for g in range(500):
        n = rnd.randrange(60, 400)
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        copy, near = list(words), False
        # Words appended at the end change one shingle each: similarity is n / (n + extra) over shingles.
        extra = int((n - 4) * 0.25) - rnd.randrange(3) if g < 400 else int((n - 4) * 0.25) + 1
        copy += [f"x{rnd.randrange(10**6)}" for _ in range(extra)]
        near = (n - 4) >= 0.8 * (n - 4 + extra)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        want += [2 * g] if near else [2 * g, 2 * g + 1]
    assert sum(1 for d in want if d % 2) == 100
    assert kept(frame(spark, rows)) == want


def test_a_family_and_a_shared_passage(spark):
    rnd = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    for i in range(300, 600):  # different texts with one passage: none may go
        rows.append((i, " ".join([f"u{rnd.randrange(10**7)}" for _ in range(rnd.randrange(40, 120))] + passage)))
    assert kept(frame(spark, rows)) == brute(rows)


def test_parities_never_exceed_the_difference():
    """Both bitmaps are lower bounds of the symmetric difference, also between sets of different classes of size."""
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 63, 64, 65, 500, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.0, 0.1, 0.3, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share], rng.integers(0, 2**63, int(n * share * 1.5)).astype(np.uint64)]))
            d = len(np.setxor1d(a, b))
            assert near_dedup.apart(near_dedup.fine_parities(a), near_dedup.fine_parities(b)) <= d
            x, y = near_dedup.parities(a), near_dedup.parities(b)
            assert np.unpackbits((x ^ y).view(np.uint8)).sum() <= d
    far = [np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)) for _ in range(2)]
    assert near_dedup.apart(*map(near_dedup.fine_parities, far)) > 10_000 / 9
