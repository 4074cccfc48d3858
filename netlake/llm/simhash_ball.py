"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most four bits have a value within two
bits of both.  So every distinct fingerprint emits all 2081 values within two
bits of itself (its variants), the shuffle brings equal variants together,
and whatever meets is a candidate.  Members of one variant are
pairwise within four bits of each other (two and two), so links to the
smallest of them connect what all their pairs would: nothing quadratic is emitted.
Colliding pairs are deduplicated and verified by counting bits.

Scale.  Equal texts and equal fingerprints meet before any variant is made, and
a variant holds at most the 2081 distinct fingerprints around it, so no
bucket is hot whatever the corpus.  Variants are dealt to ``PASSES`` passes: every bit
position has a colour (0 to 7), a variant's pass is the XOR of the colours of its set
bits, and each fingerprint has 233 or 264 variants in every pass.  One pass
makes only its own variants and its shuffle is released before the next, so disk holds an
eighth of them.  Within a pass variants are cut by a hash into parts of about
``PART`` and travel as packed arrays (8 bytes and the number of the flipped bits),
one row for each part and Arrow batch.  A task holds one part at a time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize, release
from .graph import components
from .textops import LOWER, SPACE, as_long, blocks, buffers, mix, word_spans

PASSES = 8
RADIUS = 2
#: Variants that a part holds on average at most; decides the number of parts, not the result.
PART = 1 << 21


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """All flips of at most ``RADIUS`` bits and the pass each moves a value to (XOR of colours ``bit mod 8``)."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    colour = np.arange(64) % PASSES
    return np.concatenate((np.zeros(1, np.uint64), one, one[i] | one[j])), np.concatenate(([0], colour, colour[i] ^ colour[j])).astype(np.int64)


MASKS, MOVES = _masks()
_COLOURS = [np.uint64(sum(1 << b for b in range(64) if b % PASSES >> k & 1)) for k in range(PASSES.bit_length() - 1)]


def colours(values: np.ndarray) -> np.ndarray:
    """The pass of every value: XOR of the colours of its set bits."""
    return sum((np.bitwise_count(values & m).astype(np.int64) & 1) << k for k, m in enumerate(_COLOURS))


def fingerprint_block(data: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each text: a bit is set where it is in over half of the XXH64 hashes (seed 42) of all shingles."""
    low = LOWER[data]
    token = ~SPACE[low]
    s, e, ptr = word_spans(token, off)
    # words with one space between: a shingle is then one slice
    kept = token.copy()
    kept[1:] |= token[:-1]
    low[~token] = 32
    text, place = low[kept].tobytes(), np.cumsum(kept) - 1
    n = np.diff(ptr)
    rows = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), rows)
    first = ptr[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    last = np.minimum(first + width, ptr[1:][owner]) - 1
    out = np.zeros(len(n), np.uint64)
    total = np.zeros((len(n), 64), np.int64)
    step = 1 << 16
    for a in range(0, len(owner), step):
        f, l, o = first[a : a + step], last[a : a + step], owner[a : a + step]
        h = np.array([xxhash.xxh64_intdigest(text[i:j], 42) for i, j in zip(place[s[f]].tolist(), (place[e[l] - 1] + 1).tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        cut = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        total[o[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    if len(n):
        out = np.packbits(2 * total > rows[:, None], axis=1).view(np.uint64).ravel()
    return out


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            found = [fingerprint_block(data[off[i] : off[j]], off[i : j + 1] - off[i], width) for i, j in blocks(off)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), as_long(np.concatenate(found))], names=["doc", "fp"])

    return run


def _variants(turn: int, bits: int):
    """fp -> one row (part, packed) per part: the variants of this pass and which flip made each."""
    own = [np.flatnonzero(MOVES == turn ^ c) for c in range(PASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            colour = colours(fps)
            made, flips = [], []
            for c in range(PASSES):
                mine = fps[colour == c]
                made.append((mine[:, None] ^ MASKS[own[c]]).ravel())
                flips.append(np.tile(own[c].astype(np.uint16), len(mine)))
            v, flip = np.concatenate(made), np.concatenate(flips)
            part = (mix(v) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(v), np.int64)
            order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
            v, flip = v[order], flip[order]
            ends = np.cumsum(np.bincount(part))
            held = np.flatnonzero(np.diff(np.concatenate(([0], ends))))
            yield pa.RecordBatch.from_arrays([
                pa.array(held.astype(np.int64)),
                pa.array([v[a:b].tobytes() + flip[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends))[held].tolist(), ends[held].tolist())], pa.binary()),
            ], names=["part", "packed"])

    return run


def _links(v: np.ndarray, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of a variant to the smallest fingerprint there, each once and verified."""
    order = np.argsort(v, kind="stable")
    v, fps = v[order], fps[order]
    head = np.concatenate((v[:1] == v[:1], v[1:] != v[:-1]))
    alone = head & np.concatenate((head[1:], [True]))
    fps, head = fps[~alone], head[~alone]
    if not len(fps):
        return fps, fps
    starts = np.flatnonzero(head)
    least = np.repeat(np.minimum.reduceat(fps, starts), np.diff(np.concatenate((starts, [len(fps)]))))
    pairs = np.unique(np.stack((fps, least), axis=1)[fps != least], axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= reach]
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _meet(reach: int):
    """Rows sorted by part: the variants of one part are held, sorted and linked."""

    def flush(held: list[bytes]) -> pa.RecordBatch:
        sizes = [len(x) // 10 for x in held]
        v = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in zip(held, sizes)])
        flip = np.concatenate([np.frombuffer(x, "<u2", n, 8 * n) for x, n in zip(held, sizes)])
        a, b = _links(v, v ^ MASKS[flip], reach)
        return pa.RecordBatch.from_arrays([as_long(a), as_long(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part and held:
                    yield flush(held)
                    held = []
                part = p
                held.append(x.as_py())
        if held:
            yield flush(held)

    return run


def ball_links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links among the distinct values of ``fps(fp)`` that connect exactly what pairs within ``2 * RADIUS`` bits connect."""
    fps = materialize(fps.select("fp").where("fp is not null").distinct(), "fps")
    a_pass = fps.count() * len(MASKS) // PASSES
    bits = max(0, (a_pass // PART).bit_length())
    links = None
    for turn in range(PASSES):
        parts = fps.mapInArrow(_variants(turn, bits), "part long, packed binary").repartition("part").sortWithinPartitions("part")
        new = parts.mapInArrow(_meet(2 * RADIUS), "a long, b long")
        before, links = links, materialize(new if links is None else new.union(links), "balls")
        if before is not None:
            release(before)
    out = materialize(links.distinct(), "balls")
    release(links, fps)
    return out


def simhash_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per document: ``(id, fingerprint, component_id)``; fingerprints of at most four differing bits link.

    Texts are lower-cased in A-Z, words are ``[^\\x20\\x09-\\x0D]+``; shingles count as often as they occur.
    A text of fewer words is one shingle; a null, empty or blank text has fingerprint zero and links like any other.
    ``component_id`` is the smallest id reachable.  Repeated rows stay; a row with a null id stays and links, but a null is
    no smallest id: the component of null ids alone is null.  Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprints(width), "doc long, fp long"), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    links = ball_links(least)
    label = components(links)
    least = least.join(label.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = materialize(least, "least")
    release(links)
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = least.join(ids, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
