"""Arrow-batch text helpers shared by the operators of this folder.

Texts are handled as UTF-8 byte buffers: one Arrow string column is a byte array plus
offsets, so word splitting, hashing and rolling n-grams are numpy passes over
a block of about a megabyte, never a loop over characters.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the word rule: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.RandomState(20240229).randint(0, 1 << 62, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads the bits of a weak hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_one(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``size`` bytes each (a longer text stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        m = max(n, BLOCK_BYTES + 1)
        for k, f in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(m, f, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, segment: int = BLOCK_BYTES) -> np.ndarray:
    """64-bit hash of every byte span ``[start, end)``; spans are sorted and do not overlap.

    Polynomial prefix sums modulo 2^64 over segments cut between spans, so that
    memory follows the segment and not the text.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        s = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, s + segment, "right")))
        e = int(ends[b - 1])
        up, down = _power(e - s)
        c = np.empty(e - s + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTE[codes[s:e]] * up[: e - s], out=c[1:])
        out[a:b] = (c[ends[a:b] - s] - c[starts[a:b] - s]) * down[starts[a:b] - s]
        a = b
    return mix(out)


def word_spans(token: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``token`` holds, cut at text ends, and each text's first run."""
    n = len(token)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    starts = token.copy()
    starts[1:] &= ~token[:-1] | first[1:n]
    ends = token.copy()
    ends[:-1] &= ~token[1:] | first[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``: hashes, starts, ends, and each text's first word (rows + 1)."""
    low = LOWER[data]
    s, e, ptr = word_spans(~SPACE[low], off)
    return span_hash(low, s, e), s, e, ptr


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words gives its whole sequence as one."""
    h, _, _, ptr = words(data, off)
    coef = [np.uint64(mix_one(1000 + j) | 1) for j in range(width)]
    rows = max(0, len(h) - width + 1)
    acc = np.zeros(rows, np.uint64)
    for j in range(width):
        acc += h[j : j + rows] * coef[j]
    acc = mix(acc)
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        if b - a >= width:
            x = np.sort(acc[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for j in range(b - a):
                x = mix(x * coef[j] + h[a + j])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def as_long(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs that Spark has."""
    return pa.array(h.view(np.int64))
