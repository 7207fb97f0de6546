import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import packing

SCHEMA = "doc_id long, text string, start string, ids string"


def check(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        got = sorted(by[doc_id], key=lambda r: r["start"])
        at = 0
        for r in got:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= packing.WINDOW
    return seqs


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    seqs = check(packing.packed(df).collect(), docs)
    used = sum(n for parts in seqs.values() for _, n in parts)
    assert used / (len(seqs) * packing.WINDOW) > 0.97


def test_odd_texts(spark):
    docs = [
        (1, None), (2, ""), (3, " "), (4, "a  b"), (5, "a  b c"), (6, "<|endoftext|> x"), (7, "it's a \n\n b\tc "), (8, "x" * 9000),
        (9, "\U0001f600 é   q"), (10, "word " * 5000), (11, "a\x1c b"), (12, "a \x85b"), (-1, "same"), (-2, "same"),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    check(packing.packed(df).collect(), docs)


def test_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "some words here", "", "")], SCHEMA)
    row = packing.packed(df, with_ids=True).first()
    assert row["ids"][-1] == 1 and zlib.crc32(np.array(row["ids"], dtype="<u4").tobytes()) == row["ids_crc32"]
    assert packing.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_best_fill_is_best(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 9))]
    room = rnd.randint(0, 90)
    counts = Counter(sizes)
    chosen = packing.best_fill(sorted(counts), counts, room)
    assert all(counts[k] >= n for k, n in chosen.items())
    sums = {0}
    for x in sizes:
        sums |= {s + x for s in sums}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c", "", "")] * 50 + [(7, "q", "", "")] * 50, SCHEMA)
    rows = packing.packed(df).collect()
    assert len(rows) == 100 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 100


def test_large_ids_beside_nulls_and_clashing_columns(spark):
    docs = [(2**60 + 1, "a b"), (2**60 + 3, "c d e"), (None, "f")]
    rows = packing.packed(spark.createDataFrame([(i, t, "s", "i") for i, t in docs], SCHEMA)).collect()
    assert {r["doc_id"] for r in rows} == {2**60 + 1, 2**60 + 3, None}
    cut = spark.createDataFrame([(2**60 + 1, 5, 7, 8, 9, 1), (None, 6, 7, 8, None, 2)], "doc_id long, length long, at long, pool long, sequence_id long, row long")
    got = packing.pack(cut)
    assert got.columns == ["doc_id", "length", "at", "pool", "row", "sequence_id", "offset"]
    assert {(r["doc_id"], r["length"], r["at"], r["pool"], r["row"]) for r in got.collect()} == {(2**60 + 1, 5, 7, 8, 1), (None, 6, 7, 8, 2)}


def test_ids_of_odd_texts_equal_the_library():
    rnd = random.Random(11)
    ids = packing.Ids(packing.tokenizer_path())
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "12345", "é", "ß", "漢字", "\U0001f600", "é", " ", "​", "...", "<|endoftext|>", "<|", "x" * 40, "\r\n", "_", "A1b2", "\x1c", "ΑΒ", "ї"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(ids.of(text), dtype="<u4").tolist() == ids.whole.encode(text, add_special_tokens=False).ids, repr(text)
