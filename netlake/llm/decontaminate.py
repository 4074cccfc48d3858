"""Benchmark decontamination by the q-gram lemma.

The windows of an item are all its runs of ``window`` normalised characters, one from each
character on (a shorter item is one window), so that a passage of an item that holds
``window`` characters, wherever it starts, is found.  A text region within ``e`` edits of a window of
``m`` characters shares at least ``m + 1 - q - q e`` of its q-grams, and they lie in a
band of ``e + 1`` neighbouring diagonals.  Items are indexed once, not window by window:
hits are sorted by item place in diagonal bands of width ``2 (e + 1)`` that overlap by half,
so each such region falls whole into one band, and the windows that hold enough of a
band's hits follow from the sorted places.  They are verified by an alignment within the band's
diagonals; a window whose q-grams all lie on one diagonal is equal and needs none.

Normalised: A-Z and accented Latin-1 capitals lower-cased, every run of ASCII characters that are neither
letter nor digit becomes one space; other bytes stay.

Scale.  The texts are read once, without a shuffle: the window index is a stated
query set, sent to the tasks in blocks of bounded size, one pass per block.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import blocks, buffers

Q, WINDOW, ERROR = 8, 96, 0.08
#: Benchmark bytes that one pass indexes (the index takes about forty times as much in each worker).
BLOCK_CHARS = 2_000_000

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[c for c in range(128) if not chr(c).isalnum()]] = 32
_BITS = 22


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, each text's start among them, and each byte's place in ``data``."""
    c = _CLASS[data]
    capital = (c[1:] >= 128) & (c[1:] <= 158) & (data[:-1] == 195)  # accented capitals of Latin-1
    c[1:][capital] += 32
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    at = np.flatnonzero(keep)
    return c[at], np.searchsorted(at, off), at


def grams(norm: np.ndarray, q: int) -> np.ndarray:
    """Every run of ``q`` (up to 8) bytes as one integer; the last ``q - 1`` places are absent."""
    n = max(0, len(norm) - q + 1)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out |= norm[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


class Index:
    """Items of a block and their q-grams; ``size`` is the length of an item's windows."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, error: float):
        self.q, self.texts, self.items, self.size, self.edits, self.need = q, [], [], [], [], []
        for item, text in items:
            t = normalise(*buffers(pa.array([text or ""])))[0].tobytes().strip()
            m = min(len(t), window)
            e = int(error * m)
            if m + 1 - q - q * e > 0 and m >= 2 * q:
                self.texts.append(np.frombuffer(t, np.uint8))
                self.items.append(item)
                self.size.append(m)
                self.edits.append(e)
                self.need.append(m + 1 - q - q * e)
        g = [grams(t, q) for t in self.texts]
        flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(g)), [len(x) for x in g])
        pos = np.concatenate([np.arange(len(x)) for x in g]) if g else of
        order = np.argsort(flat, kind="stable")
        self.of, self.pos = of[order], pos[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.there = np.zeros(1 << _BITS, bool)
        self.there[_slot(self.keys)] = True
        self.items, self.size, self.edits, self.need = (np.array(x, np.int64) for x in (self.items, self.size, self.edits, self.need))
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.longest = max((len(t) for t in self.texts), default=0)
        self.span = int((self.size + self.edits).max()) if len(self.size) else 0
        self.least = int(self.need.min()) if len(self.need) else 0


def _starts(key: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before it."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    for x in by:
        new[1:] |= x[1:] != x[:-1]
    return new


def regions(norm: np.ndarray, ptr: np.ndarray, ix: Index) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Equal windows as ``(text, item, place in the text)``, and those still to be aligned: ``(text, item, first diagonal of the band, start in the item)``."""
    none = (np.zeros(0, np.int64),) * 3, (np.zeros(0, np.int64),) * 4
    g = grams(norm, ix.q)
    maybe = np.flatnonzero(ix.there[_slot(g)])
    if len(maybe) < ix.least or not len(ix.keys):
        return none
    # a retained region holds at least ``least`` hits within ``span`` characters: leave what is sparser
    near = np.zeros(len(maybe), bool)
    k = ix.least - 1
    dense = np.flatnonzero(maybe[k:] - maybe[: len(maybe) - k] <= ix.span)
    if not len(dense):
        return none
    edge = np.zeros(len(maybe) + 1, np.int64)
    np.add.at(edge, dense, 1)
    np.add.at(edge, dense + k + 1, -1)
    near = np.cumsum(edge[:-1]) > 0
    maybe = maybe[near]
    at = np.searchsorted(ix.keys, g[maybe])
    at[at == len(ix.keys)] = 0
    real = ix.keys[at] == g[maybe]
    maybe, at = maybe[real], at[real]
    reps = ix.count[at]
    row = np.repeat(np.arange(len(at)), reps)
    entry = np.repeat(ix.first[at] - (np.cumsum(reps) - reps), reps) + np.arange(len(row))
    of, pos, place = ix.of[entry], ix.pos[entry], maybe[row]
    text = np.searchsorted(ptr, place, "right") - 1
    inside = place + ix.q <= ptr[text + 1]
    of, pos, place, text = of[inside], pos[inside], place[inside], text[inside]
    diag = place - pos + ix.longest  # not negative
    pair = text * len(ix.items) + of
    # equal windows: a hit at each of their places on one diagonal
    order = np.lexsort((pos, diag, pair))
    last = np.arange(len(order)) + (ix.size[of[order]] - ix.q)
    fits = np.flatnonzero(last < len(order))
    i, j = order[fits], order[last[fits]]
    i = i[(pair[i] == pair[j]) & (diag[i] == diag[j]) & (pos[j] - pos[i] == ix.size[of[i]] - ix.q)]
    whole = np.zeros(len(pos), bool)
    whole[i] = True
    equal = text[i], of[i], place[i]
    width = ix.edits[of] + 1
    out = []
    for shift in (0, 1):
        band = (diag + shift * width) // (2 * width)
        order = np.lexsort((pos, band, pair))
        group = np.cumsum(_starts(pair[order], band[order])) * (ix.longest + 1)
        last = np.arange(len(order)) + ix.need[of[order]] - 1
        fits = np.flatnonzero(last < len(order))
        i, j = order[fits], order[last[fits]]
        ok = (group[fits] == group[last[fits]]) & (pos[j] - pos[i] <= ix.size[of[i]] - ix.q)
        i, j, grp = i[ok], j[ok], group[fits[ok]]
        # each such pair of hits lies in the windows from lo to hi; both grow within a group: take what is new
        lo = np.maximum(0, pos[j] + ix.q - ix.size[of[i]])
        hi = np.minimum(pos[i], ix.length[of[i]] - ix.size[of[i]])
        same = ~_starts(grp)
        lo[1:] = np.where(same[1:], np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
        n = np.maximum(0, hi - lo + 1)
        at = np.repeat(np.arange(len(n)), n)
        start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(at))
        left = ~np.isin(grp[at] + start, (group + pos[order])[whole[order]])
        i, start = i[at[left]], start[left]
        out.append((text[i], of[i], band[i] * 2 * width[i] - shift * width[i] - ix.longest, start))
    return equal, tuple(np.concatenate(x) for x in zip(*out))


def align(patterns: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: least edits of a pattern against a part of its text, and where that part ends.

    A text starts where its band's first diagonal meets the pattern's start; cell (i, j) stands
    for text place ``i + j``, ``0 <= j < width``; the part may start at any of them.
    """
    steps = np.arange(width, dtype=np.int16)
    row = np.zeros((len(patterns), width), np.int16)
    for i in range(patterns.shape[1]):
        new = row + (texts[:, i : i + width] != patterns[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    j = row.argmin(axis=1)
    return row[np.arange(len(row)), j], patterns.shape[1] + j


def verified(norm: np.ndarray, ptr: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, item, edits, start, end)`` in normalised bytes for each window within its edit budget."""
    (t, w, place), (text, of, diag, start) = regions(norm, ptr, ix)
    yield from zip(t.tolist(), ix.items[w].tolist(), [0] * len(t), place.tolist(), (place + ix.size[w]).tolist())
    for m in np.unique(ix.size[of]).tolist():
        rows = np.flatnonzero(ix.size[of] == m)
        for part in np.array_split(rows, -(-len(rows) // 512)):
            t, w, s, e = text[part], of[part], start[part], int(ix.edits[of[part[0]]])
            width = 4 * (e + 1)
            begin = diag[part] + s - 1
            reach = begin[:, None] + np.arange(m + width)
            inside = (reach >= ptr[t][:, None]) & (reach < ptr[t + 1][:, None])
            chars = np.where(inside, norm[np.clip(reach, 0, len(norm) - 1)], 0).astype(np.uint8)
            edits, stop = align(np.stack([ix.texts[x][y : y + m] for x, y in zip(w.tolist(), s.tolist())]), chars, width)
            end = np.minimum(begin + stop, ptr[t + 1])
            first = np.maximum(np.maximum(begin, end - m - e), ptr[t])
            ok = edits <= e
            yield from zip(t[ok].tolist(), ix.items[w[ok]].tolist(), edits[ok].tolist(), first[ok].tolist(), end[ok].tolist())


def _find(ix: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = buffers(batch.column(1))
            best: dict = {}
            for i, j in blocks(off):
                norm, ptr, at = normalise(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for t, item, edits, a, b in verified(norm, ptr, ix):
                    base = int(off[i + t] - off[i])
                    row = (edits, int(at[a]) - base, int(at[b - 1]) + 1 - base)
                    o = best.get((i + t, item))
                    best[i + t, item] = row if o is None else (min(o[0], row[0]), min(o[1], row[1]), max(o[2], row[2]))
            if best:
                rows = [(ids[r], item, *v) for (r, item), v in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "edits", "start", "end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 q: int = Q, window: int = WINDOW, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, edits, start, end``.

    ``edits`` is the least over the item's windows, ``start`` and ``end`` the UTF-8 bytes that all
    found windows span (the start may lie up to the edit budget early).  Null, empty and
    very short texts or items (under 16 normalised characters) match nothing; repeated
    rows give repeated results; null ids are kept; other columns are ignored; an empty table gives no rows.
    The benchmark is read in blocks of ``block_chars`` so that no task holds more than one block's index.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ix in indexes(benchmark, item_col, item_text, q, window, error, block_chars):
        found = rows.mapInArrow(_find(ix), "doc_id long, item_id long, edits long, start long, end long")
        out = found if out is None else out.unionAll(found)
    return out


def indexes(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", q: int = Q, window: int = WINDOW, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The benchmark's items in blocks of about ``block_chars`` characters; one empty block for an empty table."""
    items, held = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct().sort("i", "t").toLocalIterator():
        if items and held + len(r.t) > block_chars:
            yield Index(items, q, window, error)
            items, held = [], 0
        items.append((r.i, r.t))
        held += len(r.t)
    yield Index(items, q, window, error)


def _clean(ix: Index, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(batch.schema.get_field_index(column)))
            keep = np.ones(batch.num_rows, bool)
            for i, j in blocks(off):
                norm, ptr, _ = normalise(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for hit in verified(norm, ptr, ix):
                    keep[i + hit[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of a benchmark item, all columns kept, without a shuffle."""
    for ix in indexes(benchmark):
        docs = docs.mapInArrow(_clean(ix, text_col), docs.schema)
    return docs
