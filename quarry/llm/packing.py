"""Packing: minimum bin slack. Each window is filled by a subset-sum over the lengths that remain in its pool."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 2048
END_ID = 1
POOL = 4096
CACHED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the other bytes from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids(dict):
    """Chunk to the bytes of its ids (little-endian uint32), for chunks that a single space separates.

    A space before a character that is no white space always begins a token of this kind of vocabulary, so the chunks
    of a text can be looked up one by one. Other texts go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        bare = chunk[1:]
        if not bare or bare != bare.strip():
            raise KeyError(chunk)
        if len(self) >= CACHED:
            self.clear()
        out = self[chunk] = np.array(self.fast.encode_ordinary(chunk), dtype="<u4").tobytes()
        return out

    def of(self, text: str) -> bytes:
        if text and not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            try:
                if first and first == first.strip():
                    return np.array(self.fast.encode_ordinary(first), dtype="<u4").tobytes() + b"".join([self[" " + x] for x in rest])
            except KeyError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ids: dict[str, Ids] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every document's ids with the end id, cut into whole windows and one rest: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    path = path or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        ids = _ids.get(path) or _ids.setdefault(path, Ids(path))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            row, start, length, crc, total, own = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                buf = ids.of(text.as_py() or "") + end
                n = len(buf) // 4
                for at in range(0, n, window):
                    part = buf[4 * at : 4 * (at + window)]
                    row.append(k), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(n)
                    if with_ids:
                        own.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The counts of a multiset of ``lengths`` (ascending, each at most ``counts`` times) whose sum comes closest to ``room`` from below.

    Bit s of ``sums`` tells whether some multiset sums to s. Counts are split into powers of two; the steps are kept
    for the way back. Once ``room`` itself is reached, no other multiset can do better.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        size = lengths[k]
        left, take = min(counts[size], room // size), 1
        while left > 0:
            take = min(take, left)
            steps.append((size, take, sums))
            sums |= (sums << (size * take)) & mask
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, defaultdict(int)
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            chosen[size] += take
    return chosen


def fill_windows(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece of a pool: the longest piece left opens a window, and the best fill completes it."""
    seq, off = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    waiting = defaultdict(list)
    for k, size in enumerate(sizes.tolist()):
        waiting[size].append(k)
    lengths = sorted(waiting)
    counts = {size: len(ks) for size, ks in waiting.items()}
    number = 0
    while lengths:
        first = lengths[-1]
        counts[first] -= 1
        chosen = best_fill(lengths, counts, window - first) if first < window else {}
        at = 0
        for size, times in [(first, 1), *chosen.items()]:
            for _ in range(times):
                k = waiting[size].pop()
                seq[k], off[k] = number, at
                at += size
        for size, times in chosen.items():
            counts[size] -= times
        lengths = [x for x in lengths if counts[x]] if any(not counts[x] for x in (first, *chosen)) else lengths
        number += 1
    return seq, off


def pack(cut: DataFrame, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """``cut`` (any columns, with ``length`` up to ``window``) with sequence_id and offset, which take the place of columns of these names.

    Pools take pieces by their place in a written table, so no value that many pieces share can fill a pool. A piece's
    own columns travel inside one struct and stay as they are. An empty table gives no rows.
    """
    own = [f for f in cut.schema if f.name not in ("sequence_id", "offset")]
    cut = materialize(cut.select(F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("row"), F.col("length").cast("long").alias("size")), "pieces")
    pools = max(1, -(-cut.count() // pool))
    dealt = cut.withColumn("at", F.monotonically_increasing_id()).withColumn("pool", F.pmod(F.xxhash64("at"), F.lit(pools)))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        seq, off = fill_windows(t.column("size").to_numpy(), window)
        first = t.column("pool")[0].as_py() << 24
        return pa.table({"row": t.column("row"), "sequence_id": pa.array(first + seq), "offset": pa.array(off)})

    out = dealt.groupBy("pool").applyInArrow(fill, f"row {cut.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return out.select("row.*", "sequence_id", "offset")


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """All documents (``doc_id``, ``text``) packed into sequences of at most ``window`` ids, one row for each piece.

    A null text counts as empty, and an empty text is its end id alone. Very long texts are cut into whole windows
    and a rest. Null ids and repeated rows are packed row by row.
    """
    return pack(pieces(docs, path, window, with_ids), window)


def op5_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
