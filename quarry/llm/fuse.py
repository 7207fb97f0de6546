"""Static three-wise binary fuse filters (Graf and Lemire, 2022) over 64-bit keys, built in whole-array rounds."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ (np.uint64(seed + 1) * _MUL)
    for shift in (33, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _cells(h: np.ndarray, segment: int, span: int) -> np.ndarray:
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, span of the first hash, fingerprints) for distinct uint64 keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 2.0
    span = max(1, -(-int(n * factor) // segment) - 2) * segment
    with np.errstate(over="ignore"):
        for seed in range(200):
            h = _mix(keys, seed)
            at = _cells(h, segment, span)
            count = np.bincount(at.ravel(), minlength=span + 2 * segment)
            owner = np.zeros(len(count), dtype=np.int64)
            for row in at:
                np.bitwise_xor.at(owner, row, np.arange(n))
            rounds, left = [], n
            while len(single := np.flatnonzero(count == 1)):
                who, where = np.unique(owner[single], return_index=True)
                rounds.append((who, single[where]))
                left -= len(who)
                for row in at[:, who]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(owner, row, who)
            if left:
                continue
            table, marks = np.zeros(len(count), dtype=np.uint16), _prints(h)
            for who, cell in reversed(rounds):
                table[cell] = 0
                a, b, c = at[:, who]
                table[cell] = marks[who] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, span, table.tobytes()
    raise ValueError("no seed peels these keys")


def contains(keys: np.ndarray, seed: int, segment: int, span: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 65,536."""
    with np.errstate(over="ignore"):
        h = _mix(keys.astype(np.uint64), seed)
        a, b, c = _cells(h, segment, span)
        t = np.frombuffer(table, dtype=np.uint16)
        return (t[a] ^ t[b] ^ t[c]) == _prints(h)
