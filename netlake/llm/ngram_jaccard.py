"""N-gram Jaccard join with PartEnum signatures.

Method.  Two sets with Jaccard >= ``num/den`` differ in at most
``k = floor((a + b)(den - num) / (den + num))`` elements.  Set sizes fall into
bands whose upper end is ``den/num`` times the lower one, so similar sets lie in
the same or in neighbouring bands; instance ``i`` covers bands ``i - 1`` and ``i``.
For an instance the feature domain is hashed into ``n1`` partitions of ``n2``
sub-partitions, and each subset of ``n2 - k2`` sub-partitions of a partition is
one signature: a hash of the elements that fall into it.  ``k`` differences
cannot reach every subset, so similar sets share a signature.

Empty subsets would meet for unrelated sets.  At least ``g`` signatures of a
similar pair agree (``g`` by worst-case placement of ``k`` differences), so a
set with fewer than ``g`` empty subsets may drop them; one with more repeats
the scheme with another hash family, and only the last family sends empties.

Links.  Within the rows that share a signature only links to one of them (the
centre) are candidates, never all pairs.  Candidates whose counts per
hash bin already rule the overlap out are dropped (an exact bound from some thirty times
fewer bytes than the sets); the others are verified on their whole sets.
Where a signature's rows still lie in different components, the pairs that
their distances to the centre (a metric) leave possible are listed by an exact
prefix filter on rare shingles and verified.  Later merges only settle more pairs, so one such round suffices and
no link between different components is lost.

Scale.  A signature that occurs again within an Arrow batch is paired there and
sent once, so a hot signature costs a row per batch in the shuffle.  The rest is
one sort by signature that is streamed; centres are sent once per salted block
of members.  Texts move once, and only those with candidates are kept.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize, release
from .graph import components
from .textops import as_long, blocks, buffers, mix, mix_one, shingle_sets

FAMILIES = 4
MEMBERS_PER_BLOCK = 256
#: Ids up to which a counted list is broadcast (16 bytes each); longer ones are joined by a shuffle.
FEW_IDS = 250_000
#: Count buckets that order shingles: 2**22 at most (16 MB a broadcast), sent in parts of 2**14.
MOST_BITS, PART = 22, 1 << 14


@lru_cache(maxsize=None)
def bands(num: int, den: int, upto: int) -> tuple[int, ...]:
    """Lower ends of the size bands, from 1 to beyond ``upto``."""
    lows = [1]
    while lows[-1] <= upto:
        lows.append(lows[-1] * den // num + 1)
    return tuple(lows)


def agreeing(n1: int, n2: int, k2: int, k: int) -> int:
    """Signatures that agree at least when ``k`` elements differ."""
    left = [comb(n2 - d, n2 - k2) for d in range(k2 + 2)]
    loss = sorted((left[d] - left[d + 1] for _ in range(n1) for d in range(k2 + 1)), reverse=True)
    return n1 * left[0] - sum(loss[:k])


@lru_cache(maxsize=None)
def scheme(low: int, high: int, k: int) -> tuple[int, int, int, int, tuple]:
    """``(n1, n2, k2, g, subsets)`` for sets of ``low`` to ``high`` elements that differ in at most ``k``."""
    if k == 0:
        n1, n2, k2 = 1, 1, 0
    elif k <= 8:
        n1, n2, k2 = k // 2 + 1, 3, 1
    else:
        n2, k2, n1 = 2, 1, k // 2 + 1
        for _ in range(3):  # room for the subsets that are empty by chance
            empty = 2 * n1 * (1 - 1 / (2 * n1)) ** low
            n1 = (k + 2 + int(empty + 4 * empty**0.5)) // 2 + 1
    return n1, n2, k2, agreeing(n1, n2, k2, k), tuple(combinations(range(n2), n2 - k2))


def signatures(values: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of one set of distinct 64-bit elements; none for an empty set."""
    size = len(values)
    if size == 0:
        return np.zeros(0, np.uint64)
    lows = bands(num, den, size * den // num + 1)
    band = int(np.searchsorted(lows, size, "right")) - 1
    out = []
    for inst in (band, band + 1):
        high = (lows[inst + 1] if inst + 1 < len(lows) else lows[inst] * den // num + 1) - 1
        k = 2 * high * (den - num) // (den + num)
        n1, n2, k2, g, subsets = scheme(lows[max(inst - 1, 0)], high, k)
        n = n1 * n2
        for family in range(FAMILIES):
            slot = ((mix(values ^ np.uint64(mix_one(inst * FAMILIES + family))) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, slot, mix(values + np.uint64(mix_one(77 + family))))
            held = np.bincount(slot, minlength=n)
            pick = np.array(subsets, np.int64)
            sig = sums.reshape(n1, n2)[:, pick].sum(axis=2, dtype=np.uint64).ravel()
            empty = held.reshape(n1, n2)[:, pick].sum(axis=2).ravel() == 0
            tag = np.arange(len(sig), dtype=np.uint64) * np.uint64(FAMILIES) + np.uint64(family)
            sig = mix(sig ^ mix(tag ^ np.uint64(mix_one(inst + 500_000))))
            enough = int(empty.sum()) < g
            out.append(sig if family == FAMILIES - 1 and not enough else sig[~empty])
            if enough:
                break
    return np.concatenate(out)


_SIGNED = "kind tinyint, sig long, doc long, other long, bins binary"


def binned(values: np.ndarray) -> bytes:
    """How many elements fall into each of about ``size / 4`` hash bins, a byte each (255: that many or more)."""
    bits = max(4, (len(values) // 4).bit_length() - 1)
    return np.minimum(np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes, n: int) -> int:
    """Elements that two binned sets share at most (``n``, the smaller size, where a bin is full)."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:
        return n
    m = min(len(x), len(y))
    return int(np.minimum(x.reshape(m, -1).sum(axis=1), y.reshape(m, -1).sum(axis=1)).sum())


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, other, n_doc, n_other, bins, bins of other) -> the first four and ``most``, an upper bound of the overlap."""
    for batch in batches:
        n, m, a, b = (batch.column(c).to_pylist() for c in range(2, 6))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([most_common(x, y, min(i, j)) for i, j, x, y in zip(n, m, a, b)], pa.int64())],
                                         names=["doc", "other", "n_doc", "n_other", "most"])


def _signed(width: int, num: int, den: int):
    """Arrow batches of (id, text) -> kind 0: a signature; 1: one paired within the batch; 2: (set size, id).

    A centre is the row that meets most others over all its signatures: the core
    of a group of near copies, not a stranger that shares a passage with it.
    ``other`` holds that count for kind 0 and the centre for kind 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = buffers(batch.column(1))
            sizes, sigs, owner, counts = np.zeros(len(ids), np.int64), [], [], []
            for i, j in blocks(off):
                for d, v in enumerate(shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width), i):
                    sizes[d] = len(v)
                    counts.append(binned(v))
                    s = signatures(v, num, den)
                    sigs.append(s)
                    owner.append(np.full(len(s), ids[d]))
            # 48 bits: a chance meeting is verified like any other, and rows shrink in the shuffle
            s, o = (np.concatenate(sigs) >> np.uint64(16)).view(np.int64), np.concatenate(owner).astype(np.int64)
            row = np.repeat(np.arange(len(ids)), [len(x) for x in owner])
            order = np.argsort(s, kind="stable")
            s, o, row = s[order], o[order], row[order]
            group = np.cumsum(np.concatenate((s[:1] == s[:1], s[1:] != s[:-1]))) - 1
            met = np.bincount(row, np.bincount(group)[group] - 1, len(ids)).astype(np.int64) if len(s) else np.zeros(len(ids), np.int64)
            order = np.lexsort((o, -met[row], group))
            s, o, row = s[order], o[order], row[order]
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            centre = o[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))] if len(s) else o
            again = ~head
            n0, n1, n2 = int(head.sum()), int(again.sum()), len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([0, 1, 2], np.int8), [n0, n1, n2])),
                pa.array(np.concatenate((s[head], s[again], sizes))),
                pa.array(np.concatenate((o[head], o[again], ids))),
                pa.array(np.concatenate((met[row[head]], centre[again], np.zeros(n2, np.int64)))),
                pa.concat_arrays([pa.nulls(n0 + n1, pa.binary()), pa.array(counts, pa.binary())]),
            ], names=["kind", "sig", "doc", "other", "bins"])

    return run


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, meetings downwards, doc): every row but the first of a signature is paired with that first; other kinds pass."""
    last_sig, last_doc, open_ = 0, 0, False
    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False)
        keep = batch.filter(pa.array(kind != 0))
        if keep.num_rows:
            yield keep
        s = batch.column(1).to_numpy(zero_copy_only=False)[kind == 0]
        o = batch.column(2).to_numpy(zero_copy_only=False)[kind == 0]
        if not len(s):
            continue
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        joined = open_ and s[0] == last_sig
        at = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
        centre = o[at]
        if joined:
            head[0] = False
            centre = np.where(at == 0, last_doc, centre)
        last_sig, last_doc, open_ = int(s[-1]), int(centre[-1]), True
        if (~head).any():
            m = ~head
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(m.sum()), np.int8)), pa.array(s[m]), pa.array(o[m]), pa.array(centre[m]), pa.nulls(int(m.sum()), pa.binary())],
                                             names=["kind", "sig", "doc", "other", "bins"])


def _route_sets(width: int):
    """(doc, text, dests) -> one row (c, salt, role, doc, set) per destination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            data, off = buffers(batch.column(1))
            dests = batch.column(2)
            for i, j in blocks(off):
                sets = [v.tobytes() for v in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)]
                part = dests.slice(i, j - i)
                flat = part.flatten()
                reps = np.diff(part.offsets.to_numpy())
                rows = np.repeat(np.arange(j - i), reps)
                step = max(1, (8 << 20) // max(1, max(map(len, sets))))
                for a in range(0, len(rows), step):
                    r, f = rows[a : a + step], flat.slice(a, step)
                    yield pa.RecordBatch.from_arrays([f.field("c"), f.field("salt"), f.field("role"), ids.slice(i, j - i).take(pa.array(r)),
                                                      pa.array([sets[x] for x in r.tolist()], pa.binary())],
                                                     names=["c", "salt", "role", "doc", "items"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (c, salt, role): the centre's set comes first, then each member's; one set is held at a time."""
    key, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for c, salt, role, doc, items in zip(*(batch.column(x) for x in range(5))):
            v = np.frombuffer(items.as_buffer(), np.uint64)
            if role.as_py() == 0:
                key, held = (c.as_py(), salt.as_py()), v.copy()
                continue
            if key != (c.as_py(), salt.as_py()):
                raise ValueError(f"no centre {c} for member {doc}")
            both = np.concatenate((held, v))
            both.sort(kind="stable")
            out.append((doc.as_py(), c.as_py(), int((both[1:] == both[:-1]).sum()), len(v), len(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc", "other", "common", "n_doc", "n_other"])


def verified(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Exact overlap of the candidate ``pairs(doc, other)``: adds ``common, n_doc, n_other, similar``."""
    members = pairs.groupBy("other").agg(F.ceil(F.count("*") / MEMBERS_PER_BLOCK).alias("blocks"))
    p = pairs.join(members, "other").select("doc", "other", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("salt"))
    go = p.select("doc", F.struct(F.col("other").alias("c"), "salt", F.lit(1).alias("role")).alias("d")).union(
        p.select("other", "salt").distinct().select("other", F.struct(F.col("other").alias("c"), "salt", F.lit(0).alias("role")).alias("d")))
    dests = go.groupBy("doc").agg(F.collect_list("d").alias("dests"))
    placed = (docs.join(dests, "doc").select("doc", "text", "dests")
              .mapInArrow(_route_sets(width), "c long, salt int, role int, doc long, items binary")
              .repartition("c", "salt").sortWithinPartitions("c", "salt", "role"))
    out = placed.mapInArrow(_verify, "doc long, other long, common long, n_doc long, n_other long")
    return out.withColumn("similar", F.expr(f"common * {den} >= (n_doc + n_other - common) * {num}"))


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(sizes, links)``: every id with its set size, and verified links ``(doc, other)``.

    ``links`` connects exactly the documents that similar pairs connect (it is not the list of all similar pairs).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    rows = docs.mapInArrow(_signed(width, num, den), _SIGNED)
    rows = rows.repartition(F.expr("if(kind = 0, sig, doc)")).sortWithinPartitions("sig", F.desc("other"), "doc")
    rows = materialize(rows.mapInArrow(_pair_up, _SIGNED), "partenum")
    sizes = materialize(rows.where("kind = 2").select("doc", F.col("sig").alias("n")), "sizes")
    shared = rows.where("kind = 1").select("sig", "doc", "other")
    info = rows.where("kind = 2").select("doc", F.col("sig").alias("n_doc"), "bins")
    pairs = shared.select("doc", "other").distinct().join(info, "doc").join(info.select(F.col("doc").alias("other"), F.col("n_doc").alias("n_other"), F.col("bins").alias("bins2")), "other")
    pairs = pairs.select("doc", "other", "n_doc", "n_other", "bins", "bins2").mapInArrow(_bounds, "doc long, other long, n_doc long, n_other long, most long").distinct()
    pairs = materialize(pairs.withColumn("may", F.expr(f"most * {den} >= (n_doc + n_other - most) * {num}")), "pairs")
    release()
    exact = verified(docs, pairs.where("may").select("doc", "other"), width, num, den).withColumn("lo", F.expr("1 - common / (n_doc + n_other - common)"))
    other = pairs.where("not may").select("doc", "other", F.lit(False).alias("similar"), F.expr("1 - most / (n_doc + n_other - most)").alias("lo"), F.lit(1.0).alias("hi"))
    tested = materialize(exact.select("doc", "other", "similar", "lo", F.col("lo").alias("hi")).union(other), "links")
    release(pairs)
    links = tested.where("similar").select("doc", "other")
    if not tested.where("not similar").isEmpty():
        label = components(links.select(F.col("doc").alias("a"), F.col("other").alias("b")))
        again = remaining(docs, shared, label, tested, width, num, den)
        more = materialize(verified(docs, again, width, num, den), "links")
        links = links.union(more.where("similar").select("doc", "other"))
        release(label, again)
    release(rows)
    return sizes, links


def remaining(docs: DataFrame, shared: DataFrame, label: DataFrame, tested: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs ``(doc, other)`` that share a signature, lie in different components and may still be similar.

    Jaccard distance is a metric, and every row of a signature has a known
    distance to its centre: rows whose distances to the signature's first centre
    (known within bounds ``lo`` and ``hi``) are further apart than the threshold
    are no candidates.  A signature's largest component (the group of near copies
    itself) meets only the strangers within that reach.  What is left is paired
    by rare shingles.
    """
    far = (den - num) / den + 1e-9
    d = shared.join(tested, ["doc", "other"])
    # two rows of a signature are one tested pair: only from three on is there anything left
    open_ = d.groupBy("sig").agg(F.count("*").alias("n"), F.min("similar").alias("all")).where("n > 1 and not all").select("sig")
    d = d.join(open_, "sig", "left_semi").select("sig", "doc", "other", "lo", "hi")
    # a centre of one batch may itself be a member under the signature's first centre
    up = d.select("sig", F.col("doc").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    rows = d.join(up, ["sig", "other"], "left").select(
        "sig", "doc", F.expr("if(lo2 is null, lo, greatest(0D, lo - hi2, lo2 - hi))").alias("lo"), F.expr("hi + coalesce(hi2, 0D)").alias("hi"))
    tops = d.select("sig", F.col("other").alias("doc")).distinct().join(d.select("sig", "doc"), ["sig", "doc"], "left_anti")
    rows = rows.union(tops.select("sig", "doc", F.lit(0.0), F.lit(0.0)))
    rows = rows.groupBy("sig", "doc").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    rows = rows.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = rows = materialize(rows, "mixed")
    main = rows.groupBy("sig", "component").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    main = main.groupBy("sig").agg(F.max(F.struct("n", "component", "lo", "hi")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("sig", F.col("m.component").alias("mc"), F.col("m.lo").alias("mlo"), F.col("m.hi").alias("mhi"))
    rows = rows.join(main, "sig")
    strangers = rows.where("component <> mc").withColumn("near", F.expr(f"lo - mhi <= {far} and mlo - hi <= {far}"))
    edge = strangers.where("near").groupBy("sig").agg(F.min("lo").alias("elo"), F.max("hi").alias("ehi"))
    mains = rows.where("component = mc").join(edge, "sig").where(f"lo - ehi <= {far} and elo - hi <= {far}")
    left = strangers.select("doc", "component").union(mains.select("doc", "component")).distinct()
    met = tested.select("doc", "other").union(tested.select(F.col("other").alias("doc"), F.col("doc").alias("other")))
    left = materialize(left, "left")
    release(mixed)
    pairs = materialize(rare_pairs(docs, left, width, num, den).join(met, ["doc", "other"], "left_anti"), "again")
    release(left)
    return pairs


def _counts(width: int, bits: int):
    """(doc, text) -> rows (part, counts): how many documents of the task hold a shingle of each of ``2**bits`` hash buckets, in parts of ``PART`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off):
                for v in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width):
                    np.add.at(total, (v >> np.uint64(64 - bits)).astype(np.int64), 1)
        for p, x in enumerate(total.reshape(-1, min(PART, 1 << bits))):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["part", "counts"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part -> one row a part with the sum; one sum is held at a time."""
    part, held = None, None
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(x, np.int64)
            if p != part and part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["part", "counts"])
            part, held = p, x if p != part else held + x
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["part", "counts"])


def _prefixes(width: int, num: int, den: int, bits: int, shared):
    """(doc, text, component) -> one row (doc, component, n, place, item) per shingle of the document's prefix, rarest bucket first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                first = []
                for v in sets:
                    keep = len(v) - -(-len(v) * num // den) + 1 if len(v) else 0
                    first.append(v[np.lexsort((v, seen[(v >> np.uint64(64 - bits)).astype(np.int64)]))[:keep]])
                sent = np.array([len(v) for v in first], np.int64)
                take = pa.array(np.repeat(np.arange(i, j), sent))
                place = np.arange(sent.sum()) - np.repeat(np.cumsum(sent) - sent, sent) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(np.repeat([len(v) for v in sets], sent).astype(np.int64)),
                                                  pa.array(place.astype(np.int64)), as_long(np.concatenate(first))], names=["doc", "component", "n", "place", "item"])

    return run


def rare_pairs(docs: DataFrame, left: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs of ``left(doc, component)`` in different components that share one of their rarest shingles.

    Under one order of all shingles similar sets share one among the first
    ``n - ceil(num n / den) + 1`` of each.  The order is by how many documents hold
    a shingle of the same hash bucket (counted over all of ``left``), then by hash: a passage
    that many documents share stands out of its buckets and comes last, so documents that
    have only that alike differ in their prefixes.  Any order is exact; the
    counts, at most ``2**MOST_BITS`` of them, are all that is broadcast.  Sets
    whose first shared place comes too late for the overlap they need are no
    candidates (positional bound).
    """
    spark = docs.sparkSession
    if left.count() <= FEW_IDS:
        left = F.broadcast(left)
    texts = docs.join(left, "doc").select("doc", "text", "component")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(12, (chars // 512).bit_length()))
    parts = texts.select("doc", "text").mapInArrow(_counts(width, bits), "part long, counts binary").repartition("part").sortWithinPartitions("part")
    seen = np.zeros(1 << bits, np.int64)
    size = min(PART, 1 << bits)
    for p, x in parts.mapInArrow(_total, "part long, counts binary").collect():
        seen[p * size : (p + 1) * size] = np.frombuffer(x, np.int64)
    shared = spark.sparkContext.broadcast(np.minimum(seen, 2**32 - 1).astype(np.uint32))
    prefixes = materialize(texts.mapInArrow(_prefixes(width, num, den, bits, shared), "doc long, component long, n long, place long, item long"), "prefixes")
    both = prefixes.groupBy("item").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("item")
    first = materialize(prefixes.join(both, "item", "left_semi"), "prefixes")
    release(prefixes)
    return first.alias("x").join(first.alias("y"), F.expr(
        f"x.item = y.item and x.doc < y.doc and x.component <> y.component and (1 + least(x.n - x.place, y.n - y.place)) * {num + den} >= (x.n + y.n) * {num}")
    ).select(F.col("x.doc").alias("doc"), F.col("y.doc").alias("other")).distinct()


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: ``(id, n_shingles, component_id)``.

    Documents link when ``den * |A n B| >= num * |A u B|`` over distinct
    ``width``-word shingles of the text lower-cased in A-Z; a text of fewer words
    is one shingle; a null, empty or blank text has none and links with nothing
    (its component is itself).  ``component_id`` is the smallest id reachable.
    A row of a null id links like any other, but a null is no smallest id: the component of null ids
    alone is null.  Rows that repeat an id are one node with the links of all of them.  Other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    nameless = rows.where("doc is null").select("text")
    if nameless.isEmpty():
        sizes, links = ngram_links(rows, "doc", "text", width, num, den)
        label = components(links.select(F.col("doc").alias("a"), F.col("other").alias("b")))
        return sizes.join(label.withColumnRenamed("node", "doc"), "doc", "left").select(
            F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    # rows without an id get numbers below the least one, written once so that they stay
    least = rows.agg(F.min("doc")).first()[0] or 0
    named = materialize(nameless.select((F.lit(least) - 1 - F.monotonically_increasing_id()).alias("doc"), "text"), "named")
    sizes, links = ngram_links(rows.where("doc is not null").union(named), "doc", "text", width, num, den)
    label = components(links.select(F.col("doc").alias("a"), F.col("other").alias("b")))
    found = sizes.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    found = materialize(found, "found")
    real = F.when(F.col("doc") >= least, F.col("doc"))
    ids = found.groupBy("component").agg(F.min(real).alias("component_id"))
    return found.join(ids, "component").select(real.alias(id_col), F.col("n").alias("n_shingles"), "component_id")
