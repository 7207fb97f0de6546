"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The transducer is compiled from a model file: the normaliser (the model's character map, white space joined if the
model says so, a space in front, spaces as U+2581), an arc for each piece, and byte arcs for characters without a piece.
Composed with a text, its states are (place, last piece), and the encoding is the shortest path in the tropical semiring. A unigram model's arcs weigh minus the piece's score. A
BPE model's arcs weigh nothing where merging the two neighbouring pieces by rank gives just those two, and are
infinite otherwise: a sequence of pieces is a text's BPE encoding exactly if each adjacent pair is the encoding of its
own text, so one path remains, and each place has a single last piece. The pieces' automaton drives the composition.
"""

from __future__ import annotations

import codecs
import math
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CHUNKS = 400_000
PAIRS = 500_000
SLICE = 256
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            c = data[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(data):
        tag = varint()
        n = {0: None, 1: 8, 5: 4}.get(tag & 7, -1)
        if n is None:
            yield tag >> 3, varint()
            continue
        n = varint() if n < 0 else n
        yield tag >> 3, data[i : i + n]
        i += n


class Chunks(dict):
    """Word (without the mark in front) to the bytes of its ids, up to CHUNKS of them."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        out = self[word] = np.array(self.encode(SPACE + word), dtype="<u4").tobytes()
        return out


class Rewriter:
    """The character map of a model: at each place the longest source that matches is replaced by its target.

    The map is stored as a double array of bytes with the targets behind it. Its arcs are followed as a text asks for
    them; a character that begins no source stays as it is.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]) if blob else ()
        self.targets = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """The length of the longest source at a place, and its target; (0, b"") without one."""
        units, found = self.units, (0, b"")
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.targets[begin : self.targets.index(b"\0", begin)])
        return found

    def __call__(self, text: str) -> str:
        if not self.units:
            return text
        raw, out, i = text.encode(), [], 0
        while i < len(raw):
            n, target = self.longest(raw, i)
            if not n:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                target = raw[i : i + n]
            out.append(target)
            i += n
        return b"".join(out).decode()


class Transducer:
    """A compiled model. What it remembers of words and pairs is bounded."""

    def __init__(self, path: str):
        self.kind, self.prefix, self.joined, self.rewrite, self.pieces = UNIGRAM, True, True, Rewriter(b""), []
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind = f.get(3, UNIGRAM)
                if self.kind not in (UNIGRAM, BPE) or f.get(24):
                    raise ValueError("only unigram and BPE models with the mark in front of words are supported")
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, self.joined, self.rewrite = bool(f.get(3, 1)), bool(f.get(4, 1)), Rewriter(f.get(2, b""))
                if not f.get(5, 1):
                    raise ValueError("only models that write spaces as the mark are supported")
        self.arcs = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.scores = [s for _, s, _ in self.pieces]
        normal = [s for _, s, kind in self.pieces if kind == NORMAL] or [0.0]
        # Weights of a unigram model's arcs, in the model's own precision, which decides between paths that weigh the same but for rounding.
        self.strange = np.float32(10) - np.float32(min(normal))  # of a character without a piece
        self.weights = [np.float32(0.1 - len(p.encode()) * max(normal) if kind == USER else -s) for p, s, kind in self.pieces]
        # The input side of the arcs as one automaton, which reads a text once and names every piece that ends at each place.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.arcs.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        # Words can be encoded one by one where no piece has the mark inside or at its end.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.arcs) and not (self.kind == UNIGRAM and any(p.startswith(SPACE + SPACE) for p in self.arcs))
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.out = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]
        self.chunks = Chunks(self.shortest)
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    def normalised(self, text: str) -> str:
        out = self.rewrite(text)
        if self.joined:
            out = " ".join(x for x in out.split(" ") if x)
        return (SPACE * self.prefix + out).replace(" ", SPACE) if out or text and not self.joined else ""

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best-scored pair first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.arcs.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, piece: int) -> tuple[int, int]:
        """The two pieces whose merge makes this one, or (-1, -1) for a character."""
        got = self.halves.get(piece)
        if got is None:
            text, got = self.pieces[piece][0], (-1, -1)
            if len(text) > 1:
                scores, cuts = self.scores, set()
                parts = list(text)
                while len(parts) > 2:
                    best, at = -math.inf, -1
                    for i in range(len(parts) - 1):
                        k = self.arcs.get(parts[i] + parts[i + 1])
                        if k is not None and scores[k] > best:
                            best, at = scores[k], i
                    if at < 0:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                got = (self.arcs[parts[0]], self.arcs[parts[1]]) if len(parts) == 2 else (-2, -2)
            self.halves[piece] = got
        return got

    def adjoins(self, a: int, b: int) -> bool:
        """Whether the pair's BPE encoding is the pair itself; with ``a`` -1 (nothing that merges), whether that of ``b`` is ``b``.

        The merges of both pieces are undone from the last one on; if the pieces that meet at the boundary at some
        time could merge before what is undone was made, the pair does not stand.
        """
        key = a * len(self.pieces) + b
        got = self.pairs.get(key)
        if got is None:
            x, y = self.pieces[a][0] if a >= 0 else "", self.pieces[b][0]
            if a < 0:
                got = self.split(b) != (-2, -2)
            elif SPACE + SPACE in x + y or -2 in self.split(a) or -2 in self.split(b):  # runs of the mark have equal scores
                got = self.merged(x + y) == [x, y]
            else:
                got = self._stands(a, b)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def _stands(self, a: int, b: int) -> bool:
        # One side at a time goes back to before its last merge; the boundary pair must not outrank the merge undone.
        after = -math.inf  # score of the merge that was undone last: what stood since then was exposed to lower ones
        right = False  # whether that merge lay right of the boundary, where equal scores come later
        while True:
            k = self.arcs.get(self.pieces[a][0] + self.pieces[b][0])
            if k is not None and (self.scores[k] > after or right and self.scores[k] == after):
                return False
            left_half, right_half = self.split(a), self.split(b)
            if left_half[1] < 0 and right_half[0] < 0:
                return True
            # Of both last merges the one with the lower score (on a tie the right one) was made later.
            sa = self.scores[a] if left_half[1] >= 0 else math.inf
            sb = self.scores[b] if right_half[0] >= 0 else math.inf
            if sa < sb:
                a, after, right = left_half[1], sa, False
            else:
                b, after, right = right_half[0], sb, True

    def shortest(self, chunk: str) -> list[int]:
        """The shortest path's ids. ``last[j]`` is the piece on the best path to place j, -1 for a character without one."""
        if self.kind == UNIGRAM:
            return self.cheapest(chunk)
        n, size, pairs = len(chunk), len(self.pieces), self.pairs
        last, done = [-1] * (n + 1), 0
        for end, (length, piece) in self.automaton.iter(chunk):
            j = end + 1
            if j == done:  # all but one path weigh infinitely much
                continue
            before = last[j - length]
            ok = pairs.get(before * size + piece)
            if ok or ok is None and self.adjoins(before, piece):
                last[j], done = piece, j
        ids, j = [], n
        while j:
            if last[j] >= 0:
                ids.append(last[j])
                j -= len(self.pieces[last[j]][0])
            else:
                j -= 1
                ids += self.fallback(chunk[j])
        return ids[::-1]

    def fallback(self, char: str) -> list[int]:
        """The byte ids of a character without a piece, last byte first."""
        return [self.bytes.get(b, self.unknown) for b in reversed(char.encode())] if self.bytes else [self.unknown]

    def cheapest(self, chunk: str) -> list[int]:
        """The shortest path where each arc weighs minus its piece's score; a character without a piece of its own has an arc too."""
        n, weights = len(chunk), self.weights
        cost, back = [np.float32(0)] + [np.float32(math.inf)] * n, [(-1, 0)] * (n + 1)
        ends, single = [[] for _ in range(n + 1)], [False] * n
        for end, (length, piece) in self.automaton.iter(chunk):
            ends[end + 1].append((length, piece))
            if length == 1:
                single[end] = True
        for j in range(1, n + 1):
            for length, piece in sorted(ends[j], reverse=True):
                if cost[j - length] + weights[piece] < cost[j]:
                    cost[j], back[j] = cost[j - length] + weights[piece], (piece, j - length)
            if not single[j - 1] and cost[j - 1] + self.strange < cost[j]:
                cost[j], back[j] = cost[j - 1] + self.strange, (-1, j - 1)
        ids, j = [], n
        while j:
            piece, i = back[j]
            ids += [piece] if piece >= 0 else self.fallback(chunk[i])
            j = i
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit numbers."""
        marked = self.normalised(text)
        if not self.bytes:  # a run of characters without a piece is one unknown
            ids = self.shortest(marked)
            return np.array([x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x], dtype="<u4").tobytes()
        if not self.by_word or not marked.startswith(SPACE):
            return np.array(self.shortest(marked), dtype="<u4").tobytes()
        if SPACE + SPACE in marked or marked.endswith(SPACE):
            words = [c[1:] for c in _CHUNK.findall(marked)]
        else:
            words = marked[1:].split(SPACE)
        return b"".join(map(self.chunks.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "each_byte")
        first = next((i for i in ids if self.pieces[i][2] != CONTROL), None)
        return text[1:] if (self.prefix or self.joined) and first is not None and self.pieces[first][0].startswith(SPACE) else text


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    return _compiled.get(path) or _compiled.setdefault(path, Transducer(path))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and round_trip (decoding gives the text back) of every row.

    A null text counts as empty and has no ids. Texts are encoded whole, however long. The mark U+2581 in a text
    decodes to a space, as it does in the library. Repeated rows get equal ids; an empty table gives no rows. Other
    columns are not read.
    """
    path = path or model_path()

    def run(batches):
        t = compiled(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [x.as_py() or "" for x in part.column("text")]
                bufs = [t.encode(x) for x in texts]
                ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in bufs]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                cols = [
                    part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))),
                    pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, bufs), pa.int64()),
                    pa.array([t.decode(i.tolist()) == x.replace(SPACE, " ") for i, x in zip(ids, texts)]),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give a null text."""
    path = path or model_path()

    def run(batches):
        t = compiled(path)
        for batch in batches:
            out = [None if x.as_py() is None else t.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def op2_sentencepiece(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))
