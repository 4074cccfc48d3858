"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel.  The gap-weighted subsequence kernel of order three on words: common
subsequences of three letters, each gap weighing ``DECAY`` (up to ``GAP`` skipped letters
between two), normalised.  Insults with inserted, doubled or changed letters keep most of
their subsequences; letters set apart by spaces or marks are joined first.

Model.  Landmarks are words of the training sample; a word's Nystroem features are its
kernel values against them times the inverse square root of the landmark kernel, and a
squared-hinge SVM separates words that mark toxic documents from common ones.  The
expansion over landmarks is linear in the kernel's subsequence features, so it is folded
into one table of 32^3 weights and scoring a word costs a few lookups, whatever the number of
landmarks.  A document scores by its strongest word, calibrated on the sample.

The sample is bounded by ``per_class`` documents a class; scoring is one pass without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_crf import held_out
from .textops import SPACE, blocks, buffers, mix

GAP, DECAY, PER_CLASS, LANDMARKS = 2, 0.6, 2000, 400
#: Clean words that training looks at (the commonest of the sample), and rounds of adding those that score highest.
CLEAN_WORDS, ROUNDS = 40_000, 3
#: Letters 1-26; look-alike digits and signs read as letters; bytes of other letters 27-30; the rest 0.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _SYMBOL[_a] = _b - 96
_SYMBOL[128:192] = 27 + np.arange(64) % 4
_STEPS = [(a, b) for a in range(1, GAP + 2) for b in range(1, GAP + 2)]


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, word_ptr, doc_ptr)``: the letters of all words, each word's first letter, each text's first word.

    Words end at white space; runs of one-letter words are joined.
    """
    sym = _SYMBOL[data]
    at = np.flatnonzero(sym)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    gaps = np.cumsum(SPACE[data])[at]
    doc = np.searchsorted(off, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (gaps[1:] != gaps[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    single = np.diff(np.append(first, len(at))) == 1
    joined = np.zeros(len(first), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[first[1:]] == doc[first[:-1]])
    first = first[~joined]
    return sym[at], np.append(first, len(at)), np.searchsorted(doc[first], np.arange(len(off)))


def word_keys(sym: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit key of every word's letters."""
    power = np.cumprod(np.full(int(np.diff(ptr).max(initial=1)), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    place = np.arange(len(sym)) - np.repeat(ptr[:-1], np.diff(ptr))
    return mix(np.add.reduceat(mix(sym.astype(np.uint64)) * power[place], ptr[:-1])) if len(sym) else np.zeros(0, np.uint64)


def subsequences(sym: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, code, value)``: the kernel's features of every word, each code once, scaled to unit length."""
    size = np.diff(ptr)
    word = np.repeat(np.arange(len(size)), size + 2)
    s = np.zeros(len(sym) + 2 * len(size), np.int64)  # 0 stands for a word's start and end
    s[np.arange(len(sym)) + 2 * np.repeat(np.arange(len(size)), size) + 1] = sym
    keys, values = [], []
    for a, b in _STEPS:
        n = len(s) - a - b
        if n <= 0:
            continue
        same = word[:n] == word[a + b :]
        code = s[:n] * 1024 + s[a : a + n] * 32 + s[a + b :]
        keys.append((word[:n] * 32768 + code)[same])
        values.append(np.full(int(same.sum()), DECAY ** (a + b - 2)))
    if not keys or not sum(map(len, keys)):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    value, key = np.add.reduceat(value, first), key[first]
    w = key >> 15
    norm = np.sqrt(np.bincount(w, value * value, len(ptr) - 1))
    return w, key & 32767, value / norm[w]


def _take(sym: np.ndarray, ptr: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(ptr)[which]
    out = np.concatenate(([0], np.cumsum(size)))
    return sym[np.arange(out[-1]) + np.repeat(ptr[which] - out[:-1], size)], out


@dataclass
class ToxicModel:
    """``table`` over subsequence codes and ``bias`` give a word's margin; ``scale`` (margin, length, offset) a text's log-odds."""

    table: np.ndarray
    bias: float
    scale: np.ndarray

    def strongest(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest word margin (that of an unknown word if it has none) and its number of words."""
        sym, ptr, docs = split_words(data, off)
        n = np.diff(docs)
        out = np.full(len(n), self.bias)
        if len(sym):
            _, one, back = np.unique(word_keys(sym, ptr), return_index=True, return_inverse=True)
            w, code, value = subsequences(*_take(sym, ptr, one))
            margin = (np.bincount(w, value * self.table[code], len(one)) + self.bias)[back]
            some = np.flatnonzero(n)
            out[some] = np.maximum.reduceat(margin, docs[:-1][some])
        return out, n

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        top, n = self.strongest(data, off)
        z = self.scale[0] * top + self.scale[1] * np.log1p(n) + self.scale[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM (last column of ``x`` is constant) by Newton steps on the active rows."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * l2
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x[on] + ridge, a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - l2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def marks_of(f: tuple) -> np.ndarray:
    """Features ``(word, code, value)`` as rows over all codes."""
    w, code, value = f
    out = np.zeros((int(w.max()) + 1, 32768), np.float32)
    out[w, code] = value
    return out


def against(f: tuple, n: int, marks: np.ndarray, step: int = 16_000) -> np.ndarray:
    """Kernel values of ``n`` words against landmark rows, a bounded number of features at a time."""
    w, code, value = f
    out, by_code = np.zeros((n, len(marks)), np.float32), np.ascontiguousarray(marks.T)
    for a in range(0, len(w), step):
        part = w[a : a + step]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out[part[first]] += np.add.reduceat(by_code[code[a : a + step]] * value[a : a + step, None].astype(np.float32), first, axis=0)
    return out


def train(texts: list[str], toxic: np.ndarray, share: float, landmarks: int = LANDMARKS) -> ToxicModel | None:
    """Fit on labelled texts; ``share`` is the toxic share among all labelled rows.  None when a class is missing."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    data, off = buffers(pa.array(texts, pa.string()))
    syms, ptrs, docss, keyss = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
    for i, j in blocks(off):  # the driver holds one block's index arrays at a time
        a, b, c = split_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        syms.append(a)
        ptrs.append(b[1:] + ptrs[-1][-1])
        docss.append(c[1:] + docss[-1][-1])
        keyss.append(word_keys(a, b))
    sym, ptr, docs, keys = (np.concatenate(x) for x in (syms, ptrs, docss, keyss))
    if not len(sym):
        return None
    keys, one, back = np.unique(keys, return_index=True, return_inverse=True)
    some = np.flatnonzero(np.diff(docs))
    duo = keys[back]
    duo[:-1] = mix(duo[:-1] * np.uint64(3) + duo[1:])  # neighbouring words; a text's last word stands alone
    duo[docs[1:][some] - 1] = keys[back[docs[1:][some] - 1]]
    mins = np.stack([np.minimum.reduceat(mix(duo ^ np.uint64(salt)), docs[:-1][some]) for salt in (1, 2)], 1)
    alone = np.zeros(len(texts), bool)  # of near copies (two equal minimum hashes) one counts, else their words look like evidence
    alone[some[np.unique(mins, axis=0, return_index=True)[1]]] = True
    doc = np.repeat(np.arange(len(texts)), np.diff(docs))
    back, doc = back[alone[doc]], doc[alone[doc]]
    pair = np.unique(doc * len(keys) + back)
    c1 = np.bincount((pair % len(keys))[toxic[pair // len(keys)]], minlength=len(keys))
    c0 = np.bincount((pair % len(keys))[~toxic[pair // len(keys)]], minlength=len(keys))
    n1, n0 = (toxic & alone).sum(), (~toxic & alone).sum()
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    sure = odds / np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    size = np.diff(ptr)[one]
    bad = np.flatnonzero((sure > 1.96) & (c1 >= 5) & (odds > 1.5) & (size >= 3))
    bad = bad[np.argsort(-sure[bad], kind="stable")][:1000]
    fine = np.flatnonzero((odds < 0.7) & (c0 >= 1) & (size >= 3))
    fine = fine[np.argsort(-c0[fine], kind="stable")][:CLEAN_WORDS]
    if not len(bad) or not len(fine):
        return None
    features = lambda which: subsequences(*_take(sym, ptr, one[which]))
    del back, doc, pair, duo, keyss, keys
    hard = np.arange(min(4000, len(fine)))  # first the commonest clean words, then also those that score highest
    marks = bad[:landmarks // 2]
    model = None
    for _ in range(ROUNDS):
        words = np.concatenate((bad, fine[hard]))
        near = marks_of(features(np.concatenate((marks, fine[hard[-(landmarks - len(marks)):]]))))
        values, vectors = np.linalg.eigh((near @ near.T).astype(float))
        root = vectors * (np.maximum(values, 1e-4) ** -0.5)
        z = np.hstack((against(features(words), len(words), near) @ root, np.ones((len(words), 1))))
        y = np.where(np.arange(len(words)) < len(bad), 1.0, -1.0)
        weight = np.concatenate((c1[bad] / c1[bad].sum(), np.full(len(hard), 2.0 / len(hard))))
        v = _svm(z, y, weight)
        model = ToxicModel((near.T @ (root @ v[:-1])).astype(np.float64), float(v[-1]), np.zeros(3))
        margin = np.zeros(len(fine))
        for a in range(0, len(fine), 4000):
            w, code, value = features(fine[a : a + 4000])
            margin[a : a + 4000] = np.bincount(w, value * model.table[code], len(fine[a : a + 4000]))
        worst = np.argsort(margin, kind="stable")[-4000:]
        hard = np.concatenate((np.setdiff1d(hard, worst), worst))
    top, n = (np.concatenate(x) for x in zip(*(model.strongest(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off))))
    x = np.stack((top, np.log1p(n), np.ones(len(n))), 1)
    model.scale = _logit(x, toxic.astype(float), np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean())))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicModel | None:
    """Train on about ``per_class`` documents of each class, drawn by a hash of the id from labelled rows not held out."""
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where(~held_out("i") & F.expr("y is not null"))
    counts = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 30, (per_class << 30) // n)))])
    chosen = lab.where(F.pmod(F.xxhash64("i", F.lit(23)), F.lit(1 << 30)) < share[F.col("y")])
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(F.broadcast(chosen), "i").collect()
    sample.sort(key=lambda r: (r.i, r.t))
    return train([r.t for r in sample], np.array([r.y == 1 for r in sample]), counts.get(1, 0) / sum(counts.values()))


def _score(model: ToxicModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for i, j in blocks(off, 4 << 20) if model else ():
                out[i:j] = model.scores(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def predict(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` per row; null and empty texts score as texts without words.

    Without a model (a class is missing among the labels) every score is 0.  Repeated rows
    repeat; null ids are kept; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, score double, predicted int")
