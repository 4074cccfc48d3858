"""Packing: best-fit decreasing over piece lengths.

A document is its token ids and a closing id.  Documents longer than a window
are first cut into full windows; what remains is packed by best-fit
decreasing: longest first, each piece into the open window with the least room
that still holds it, found in a segment tree indexed by remaining capacity.

Scale.  Pieces of one length are interchangeable, so the packing is a function of
how many pieces there are of each length: at most ``window`` counts, whatever
the corpus.  The plan (ranges of equal-length pieces to ranges of windows) is
made from those counts; its size depends on the window only.  Each piece finds its rank
among the pieces of its length from its rank within its task plus the counts of
earlier tasks, so no length, however common, is ordered in one place.  Tokens are
read once and never shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import materialize
from .tokens import tokeniser

CLOSING_ID = 0


class CapacityTree:
    """Segment tree over capacities ``0..top``: which have an open window, and the smallest such at or above a value."""

    def __init__(self, top: int):
        self.leaves = 1
        while self.leaves <= top:
            self.leaves *= 2
        self.held = [False] * (2 * self.leaves)

    def set(self, capacity: int, open_: bool) -> None:
        i = capacity + self.leaves
        self.held[i] = open_
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def least(self, capacity: int) -> int | None:
        i = capacity + self.leaves
        while not self.held[i]:
            while i & 1:  # a right child: what is above it lies further up
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.held[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """``(ranges, windows)`` for ``counts`` pieces per length (1 to ``window``).

    A range ``(length, rank, window, offset)`` sends the pieces of that length from
    ``rank`` on to consecutive windows from ``window`` on, at ``offset``, up to the next range.
    """
    ranges, next_window = [], 0
    tree, stacks = CapacityTree(window), {}

    def put(capacity: int, start: int, n: int) -> None:
        if capacity and n:
            stacks.setdefault(capacity, []).append((start, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.least(length)
            if room is None:
                room, each = window, window // length
                start, n = next_window, -(-left // each)
                next_window += n
            else:
                each = room // length
                start, n = stacks[room].pop()
                if not stacks[room]:
                    tree.set(room, False)
            whole = min(n, left // each)
            for j in range(each if whole else 0):
                ranges.append((length, rank, start, window - room + j * length))
                rank += whole
            left -= whole * each
            put(room - each * length, start, whole)
            if n > whole:
                if left < each:  # the last pieces of this length share one window
                    for j in range(left):
                        ranges.append((length, rank, start + whole, window - room + j * length))
                        rank += 1
                    put(room - left * length, start + whole, 1)
                    put(room, start + whole + 1, n - whole - 1)
                    left = 0
                else:
                    put(room, start + whole, n - whole)
    return np.array(ranges, np.int64).reshape(-1, 4), next_window


def _cut(files: tuple, window: int):
    """(id, text) -> pieces with their rank among this task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = tokeniser(*files), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tok.ids(text.as_py()), np.uint32(CLOSING_ID)).astype("<u4", copy=False)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    out.append((doc, start, n, crc32(piece.tobytes()), len(ids), task, int(seen[n])))
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])

    return run


def _place(ranges: np.ndarray):
    order = np.lexsort((ranges[:, 1], ranges[:, 0]))
    lengths, ranks, windows, offsets = ranges[order].T
    shift = 1 << 48
    keys = lengths * shift + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(windows[at] + rank - ranks[at]), pa.array(offsets[at])],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, files: tuple, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document closes with id 0; a null or empty text is that id alone.  Rows
    are packed one by one, so repeated rows or ids are packed each; a null id
    stays null; other columns are ignored; an empty table gives no pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_cut(files, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"), "pieces")
    held = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = held.select("task", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    ranges, _ = best_fit_plan(counts, window)
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(ranges), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
