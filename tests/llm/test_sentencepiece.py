import random

import numpy as np
import pytest
import sentencepiece

from quarry.llm import sentencepiece_wfst as wfst


@pytest.fixture(scope="module")
def both():
    return wfst.compiled(wfst.model_path()), sentencepiece.SentencePieceProcessor(model_file=wfst.model_path())


def ids(t, x):
    return np.frombuffer(t.encode(x), dtype="<u4").tolist()


def test_random_texts(both):
    t, sp = both
    rnd = random.Random(1)
    letters = "aab  c\n\té▁ thein\U0001f600執ゼ.,ﬁ \x00Z<s>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += [" " * k + "a" + " " * k for k in range(40)] + ["▁", "a▁b", "x" * 5000, "the " * 3000]
    for x in texts:
        assert ids(t, x) == sp.encode(x)
        assert t.decode(ids(t, x)) == sp.decode(sp.encode(x))


def test_decode_any_ids(both):
    t, sp = both
    rnd = random.Random(2)
    for _ in range(3000):
        seq = [rnd.randrange(1, 32000) if rnd.random() < 0.6 else rnd.randrange(3, 259) for _ in range(rnd.randint(0, 12))]
        assert t.decode(seq) == sp.decode(seq)


def test_documents(spark, both):
    _, sp = both
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    out = wfst.encoded(df)
    rows = out.collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"]: r["text"] for r in wfst.decoded(out).collect()} == texts


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (None, "a", 5)], "doc_id long, text string, ids int")
    got = wfst.encoded(df).collect()
    assert [r["n_tokens"] for r in got] == [0, 0, 1, 1] and wfst.encoded(df.limit(0)).count() == 0


def test_bounded_memory(both, monkeypatch):
    t, sp = both
    monkeypatch.setattr(wfst, "CHUNKS", 5)
    monkeypatch.setattr(wfst, "PAIRS", 5)
    x = "some words come again some words do not and some are long enough"
    assert ids(t, x) == sp.encode(x) and len(t.chunks) <= 5


def message(*fields):
    """A protocol buffer message of (number, value) fields: int, float, str or bytes."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model(path, pieces, rule, prefix, joined, with_bytes):
    """A unigram model written by hand, with the library's own character map of that name."""
    spec = dict(wfst._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())) if rule else {}
    all_pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []), *((p, s, 1) for p, s in pieces)]
    body = [(1, message((1, p), (2, float(s)), (3, kind))) for p, s, kind in all_pieces]
    body += [(2, message((3, 1), (35, int(with_bytes)))), (3, message((1, rule or "identity"), (2, spec.get(2, b"")), (3, int(prefix)), (4, int(joined)), (5, 1)))]
    path.write_bytes(message(*body))
    return str(path)


def paths(t, chunk, at=0):
    """All segmentations of a chunk with their weights."""
    if at == len(chunk):
        yield 0.0, []
        return
    alone = False
    for end in range(at + 1, len(chunk) + 1):
        k = t.arcs.get(chunk[at:end])
        if k is not None:
            alone = alone or end == at + 1
            for w, rest in paths(t, chunk, end):
                yield w + t.weights[k], [k, *rest]
    if not alone:
        for w, rest in paths(t, chunk, at + 1):
            yield w + t.strange, [-1, *rest]


@pytest.mark.parametrize("rule,prefix,joined,with_bytes", [("nmt_nfkc", True, True, True), ("nfkc_cf", True, True, False), ("nmt_nfkc_cf", False, True, True), ("nfkc", True, False, True), (None, True, False, False), (None, False, True, True)])
def test_unigram_models(tmp_path, rule, prefix, joined, with_bytes):
    rnd = random.Random(7)
    letters = "abcd▁"
    pieces = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))): 0 for _ in range(60)} | {x: 0 for x in "ab▁"} | {"é": 0}
    pieces = [(p, -rnd.uniform(1, 12)) for p in pieces]
    path = model(tmp_path / "m.model", pieces, rule, prefix, joined, with_bytes)
    t, sp = wfst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    some = ["a", "b", "c", "d", "ab", " ", "  ", "é", "é", "ﬁ", "Ⅷ", "Ａ", "\t", "　", "​", "\U0001f600", "㍿", "ÀB", "ß", "\x07"]
    for _ in range(1500):
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 12)))
        assert t.normalised(text) == "".join(sp.normalize(text)), repr(text)
        assert ids(t, text) == sp.encode(text), repr(text)
        assert t.decode(ids(t, text)) == sp.decode(sp.encode(text)), repr(text)
    for _ in range(200):
        chunk = "".join(rnd.choice("abcdx▁") for _ in range(rnd.randint(0, 8)))
        best = min(w for w, _ in paths(t, chunk))
        got = t.cheapest(chunk)
        own = [x for x in got if x >= 3 + 256 * with_bytes]
        assert sum(t.weights[x] for x in own) + t.strange * (len(got) - len(own)) == pytest.approx(best)
