"""Language ID: a linear-chain conditional random field over words.

Each word of a text is a position; its states are the languages.  Features:
affixes (first one to three and last one to four bytes), byte trigrams with word
ends, and the whole word (lexicon), hashed into one weight table; transitions and a
start vector are learned with them.  Forward-backward gives every word's posterior, so
code-switched texts get the right share of each language; the text's
language is the one with the most posterior words.

Training: a bounded sample of labelled documents (``per_label`` documents a
language, expected) on the driver; sequences are segments of documents of different
languages put one after another, so that transitions are seen.  Prediction: one pass over the
texts in Arrow batches without a shuffle; long texts are cut into pieces whose transfer
matrices are composed, which gives the exact posteriors.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import blocks, buffers, mix, span_hash, word_spans

BITS, PER_LABEL, PIECE = 18, 500, 128
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_TAGS = [np.uint64(int(x)) for x in mix(np.arange(1, 16, dtype=np.uint64))]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id's text is divisible by five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(fixed, tri, tri_ptr, word_ptr)``: eight hashed features a word, its trigrams, and each text's first word."""
    low = _FOLD[data]
    upper = (low[1:] >= 128) & (low[1:] <= 158) & (data[:-1] == 195)  # accented capitals
    low[1:][upper] += 32
    s, e, ptr = word_spans(low != 32, off)
    pad = np.concatenate((np.full(4, 32, np.uint8), low, np.full(4, 32, np.uint8)))
    four = pad[:-3].astype(np.uint64)
    for j in (1, 2, 3):
        four |= pad[j : len(pad) - 3 + j].astype(np.uint64) << np.uint64(8 * j)
    size = e - s
    shift = np.uint64(64 - BITS)
    fixed = np.empty((len(s), 8), np.int64)
    for k in (1, 2, 3):
        n = np.minimum(size, k).astype(np.uint64)
        v = four[s + 4] & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1))
        fixed[:, k - 1] = mix(v + _TAGS[k]) >> shift
    for k in (1, 2, 3, 4):
        n = np.minimum(size, k)
        v = four[e + 4 - n] & ((np.uint64(1) << (n.astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        fixed[:, 2 + k] = mix(v + _TAGS[4 + k]) >> shift
    fixed[:, 7] = span_hash(low, s, e) >> shift
    tri_ptr = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(tri_ptr[-1]) + np.repeat(s - tri_ptr[:-1], size) + 3
    tri = ((four[at] & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    return fixed, tri.astype(np.int64), tri_ptr, ptr


@dataclass
class Crf:
    """Weights: feature slots x labels, transitions (from, to), start."""

    labels: list[str]
    weight: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, fixed: np.ndarray, tri: np.ndarray, tri_ptr: np.ndarray) -> np.ndarray:
        if not len(fixed):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(self.weight[tri], tri_ptr[:-1], axis=0)
        for k in range(fixed.shape[1]):
            out += self.weight[fixed[:, k]]
        return out


def posteriors(em: np.ndarray, ptr: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior of every word's label, and with ``pairs`` the expected transition counts.

    Pieces of ``PIECE`` words run side by side.  For texts of several pieces, the pieces'
    transfer matrices give the messages at their borders first.
    """
    n_words, n_lab = em.shape
    size = np.diff(ptr)
    n_pieces = -(-size // PIECE)
    doc = np.repeat(np.arange(len(size)), n_pieces)
    total = len(doc)
    if not total:
        return np.zeros((0, n_lab)), np.zeros((n_lab, n_lab))
    first = np.concatenate(([0], np.cumsum(n_pieces)))
    number = np.arange(total) - first[doc]
    begin = ptr[doc] + number * PIECE
    length = np.minimum(PIECE, ptr[doc + 1] - begin)
    cols = np.arange(int(length.max()))
    live = cols < length[:, None]
    at = np.where(live, begin[:, None] + cols, 0)
    e = np.exp(em - em.max(axis=1, keepdims=True))[at]
    t_all, opening = np.exp(trans), np.exp(start - start.max())
    t_first = np.where((number == 0)[:, None, None], np.tile(opening, (n_lab, 1)), t_all)

    def forward(state: np.ndarray, who: np.ndarray, keep: bool) -> np.ndarray:
        out = np.empty((len(who), len(cols), n_lab)) if keep else None
        for c in cols:
            step = (np.einsum("nki,nij->nkj", state, t_first[who]) if c == 0 else state @ t_all) * e[who, c][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            state = np.where(live[who, c][:, None, None], step, state)
            if keep:
                out[:, c] = state[:, 0]
        return out if keep else state

    left = np.full((total, n_lab), 1.0 / n_lab)
    right = np.ones((total, n_lab))
    several = np.flatnonzero((n_pieces > 1)[doc])
    if len(several):
        move = np.zeros((total, n_lab, n_lab))
        move[several] = forward(np.tile(np.eye(n_lab), (len(several), 1, 1)), several, False)
        for k in range(1, int(n_pieces.max())):
            now = first[:-1][n_pieces > k] + k
            v = np.einsum("ni,nij->nj", left[now - 1], move[now - 1])
            left[now] = v / v.sum(axis=1, keepdims=True)
            now = first[1:][n_pieces > k] - k
            v = np.einsum("nij,nj->ni", move[now], right[now])
            right[now - 1] = v / v.sum(axis=1, keepdims=True)
    alpha = forward(left[:, None, :], np.arange(total), True)
    gamma = np.empty((n_words, n_lab))
    expected = np.zeros((n_lab, n_lab))
    beta = right
    for c in cols[::-1]:
        on = live[:, c]
        g = alpha[:, c] * beta
        g /= g.sum(axis=1, keepdims=True)
        gamma[at[on, c]] = g[on]
        into = e[:, c] * beta
        if pairs:
            before = alpha[:, c - 1] if c else left
            inner = on & ((c > 0) | (number > 0))
            x = before[inner][:, :, None] * t_all * into[inner][:, None, :]
            expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = into @ t_all.T
        beta = np.where(on[:, None], b / b.sum(axis=1, keepdims=True), beta)
    return gamma, expected if pairs else None


def train(texts: pa.Array | list[str], labels: list[str], epochs: int = 6, batches: int = 12, segment: int = 60, rate: float = 0.25, l2: float = 1e-6, seed: int = 7) -> Crf | None:
    """Fit by AdaGrad on the conditional log-likelihood; None without labelled words.

    Only the texts' bytes and the segments' byte ranges are held throughout; features are made for one mini-batch at a time.
    """
    names = sorted(set(labels))
    data, off = buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    pieces = []  # first byte, end, label of every ``segment`` words
    for i, j in blocks(off):
        s, e, ptr = word_spans(_FOLD[data[off[i] : off[j]]] != 32, off[i : j + 1] - off[i])
        for d, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist()), i):
            at = np.arange(a, b, segment)
            last = np.minimum(at + segment, b) - 1
            pieces.append(np.stack((s[at] + off[i], e[last] + off[i], np.full(len(at), names.index(labels[d]))), axis=1))
    pieces = np.concatenate(pieces) if pieces else np.zeros((0, 3), np.int64)
    if not len(pieces):
        return None
    rng = np.random.RandomState(seed)
    n_lab = len(names)
    m = Crf(names, np.zeros((1 << BITS, n_lab), np.float32), np.zeros((n_lab, n_lab)), np.zeros(n_lab))
    sums = [np.full(x.shape, 1e-3, x.dtype) for x in (m.weight, m.trans, m.start)]
    share = np.bincount(pieces[:, 2], minlength=n_lab) / len(pieces)
    keep = np.minimum(1, share[share > 0].min() * 3 / np.maximum(share, 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        order = order[rng.rand(len(order)) < keep[pieces[order, 2]]]
        for part in np.array_split(order, batches):
            if not len(part):
                continue
            # the segments' bytes with a blank after each: as if they were texts of their own
            cut = [data[a:b] for a, b, _ in pieces[part].tolist()]
            stop = np.cumsum([len(x) + 1 for x in cut])
            buf = np.full(int(stop[-1]), 32, np.uint8)
            for x, z in zip(cut, stop.tolist()):
                buf[z - 1 - len(x) : z - 1] = x
            fixed, tri, tri_ptr, ptr = word_features(buf, np.concatenate(([0], stop)))
            fixed, tri = fixed.astype(np.int32), tri.astype(np.int32)
            y = np.repeat(pieces[part, 2], np.diff(ptr))
            group = np.unique(np.concatenate(([0], ptr[1:][3::4], ptr[-1:])))  # four segments make one code-switched sequence
            em = m.emissions(fixed, tri, tri_ptr)
            gamma, pair = posteriors(em, group, m.trans, m.start, True)
            diff = -gamma
            diff[np.arange(len(y)), y] += 1
            inner = np.setdiff1d(np.arange(1, len(y)), group)
            seen = np.zeros((n_lab, n_lab))
            np.add.at(seen, (y[inner - 1], y[inner]), 1)
            sizes = np.diff(tri_ptr)
            step_start = diff[group[:-1]].sum(axis=0)
            for k in range(n_lab):  # one label's column at a time
                grad = np.bincount(tri, np.repeat(diff[:, k], sizes), 1 << BITS)
                for c in range(fixed.shape[1]):
                    grad += np.bincount(fixed[:, c], diff[:, k], 1 << BITS)
                grad -= l2 * len(y) * m.weight[:, k]
                sums[0][:, k] += grad * grad
                m.weight[:, k] += rate * grad / np.sqrt(sums[0][:, k])
            for x, g, h in zip((m.trans, m.start), (seen - pair, step_start), sums[1:]):
                h += g * g
                x += rate * g / np.sqrt(h)
    return m


def judge(model: Crf | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of a column."""
    data, off = buffers(texts)
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    for i, j in blocks(off) if model else ():
        cut = data[off[i] : off[j]]
        fixed, tri, tri_ptr, ptr = word_features(cut, off[i : j + 1] - off[i])
        gamma, _ = posteriors(model.emissions(fixed, tri, tri_ptr), ptr, model.trans, model.start)
        mass = np.concatenate((np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)))
        mass = mass[ptr[1:]] - mass[ptr[:-1]]
        letter = np.concatenate(([0], np.cumsum(((cut | 32) >= 97) & ((cut | 32) <= 122) & (cut < 128))))
        plain = letter[off[i + 1 : j + 1] - off[i]] > letter[off[i:j] - off[i]]
        for d in np.flatnonzero(np.diff(ptr) > 0).tolist():
            if plain[d] or any(ch.isalpha() for ch in texts[i + d].as_py()):
                k = int(mass[d].argmax())
                pred[i + d], score[i + d] = model.labels[k], min(1.0, mass[d, k] / (ptr[d + 1] - ptr[d]))
    return pred, score


def _predict(model: Crf | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judge(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def _accepted(model: Crf | None, column: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judge(model, batch.column(batch.schema.get_field_index(column)))
            yield batch.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Crf | None, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least`` of its words; all columns stay."""
    return docs.mapInArrow(_accepted(model, text_col, least), docs.schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> Crf | None:
    """Train on about ``per_label`` documents of each label, drawn by a hash of the id from the rows not held out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).alias("l")).where(~held_out("i") & F.expr("l is not null and t is not null"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 30, (per_label << 30) // n)))])
    sample = rows.where(F.pmod(F.xxhash64("i", F.lit(17)), F.lit(1 << 30)) < share[F.col("l")]).select("i", "t", "l").toArrow()
    sample = sample.sort_by([("i", "ascending"), ("t", "ascending")]).select(["t", "l"]).combine_chunks()
    return train(sample.column("t").chunk(0), sample.column("l").to_pylist()) if sample.num_rows else None


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row; ``und`` and 0 for null or letterless text or without a model.

    ``score`` is the share of the text's words that the posteriors give to the language.  Repeated
    rows repeat; null ids are kept; other columns are ignored; ties go to the first label in order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
