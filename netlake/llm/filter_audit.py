"""Filter interaction audit over a sparse document-term matrix.

``term_matrix`` gives every distinct word of the corpus a dense id and every
document a row of a compressed sparse matrix: CSR shards of about ``SHARD_BYTES`` of text
(or one longer text) hold row pointers, word ids and counts.  Row sums are word counts,
non-zero counts are distinct words; with character counts and the smallest id of
each text they decide the filters, and one grouped pass over failure masks gives every
order of the filters at once.

Scale.  A shard first numbers its own words in the order of a hash, so that the global dictionary sees a
word once a shard and not once a use.  Shard dictionaries are cut into hash ranges of about ``PART_WORDS`` words and
shuffled as packed text, one row a range and shard; a task numbers one range at a time, exactly by the words
themselves, and sends each shard its ids back.  Texts are read once.  The masks of
all documents aggregate to at most 32 rows for each part and label pair; orders are
expanded only there.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import materialize, release
from .textops import SPACE, blocks, buffers, span_hash, word_spans

SHARD_BYTES = 4 << 20
#: Words of all shards together that a hash range holds on average, and that are numbered at once.
PART_WORDS = 1 << 20
#: The characters of filter D.
MARKS = "#$%&*|"
FILTERS = "ABCDE"
_MARK = np.isin(np.arange(256), np.frombuffer(MARKS.encode(), np.uint8))

_ROWS = "shard long, doc array<long>, part array<string>, digest array<binary>, chars array<long>, upper array<long>, marked array<boolean>, starts binary, counts binary"


def _totals(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often ``flag`` holds in each text."""
    c = np.concatenate((np.zeros(1, np.int64), np.cumsum(flag, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers of the least width that holds them all: a byte that names the width, then all lowest bytes, all second ones and so on."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    width = b[0]
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel()


def _texts(sizes: np.ndarray, data: bytes | np.ndarray) -> pa.LargeStringArray:
    """Words of the given sizes that stand one after the other in ``data``."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


def _flat(words: pa.LargeStringArray) -> tuple[np.ndarray, bytes]:
    """Sizes and joined bytes of an array that starts at its buffer's start."""
    data, off = buffers(words)
    return np.diff(off), data[off[0] : off[-1]].tobytes()


def _hashes(words: pa.LargeStringArray) -> np.ndarray:
    data, off = buffers(words)
    return span_hash(data, off[:-1], off[1:])


def _local_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, part, text) -> CSR shards over the shard's own dictionary: ``words`` and their ``sizes``, in the order of their hashes."""
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, off = buffers(batch.column(2))
        for i, j in blocks(off, SHARD_BYTES):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            token = ~SPACE[d]
            s, e, ptr = word_spans(token, o)
            words = _texts(e - s, d[token].tobytes()).dictionary_encode()
            order = np.argsort(_hashes(words.dictionary), kind="stable")
            code = np.empty(len(order), np.int64)
            code[order] = np.arange(len(order))
            sizes, joined = _flat(words.dictionary.take(pa.array(order)))
            top = max(1, len(order))
            row = np.repeat(np.arange(j - i), np.diff(ptr))
            cells, counts = np.unique(row * top + code[words.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            starts = np.searchsorted(cells, np.arange(j - i + 1) * top)
            steps = np.diff(cells % top, prepend=0)
            steps[starts[:-1][np.diff(starts) > 0]] = cells[starts[:-1][np.diff(starts) > 0]] % top
            lists = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([blake2b(d[a:b], digest_size=16).digest() for a, b in zip(o[:-1], o[1:])], pa.binary()),
                     pa.array(_totals((d & 0xC0) != 0x80, o)), pa.array(_totals((d >= 65) & (d <= 90), o)), pa.array(_totals(_MARK[d], o) > 0)]
            columns = [pa.array([shard], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x) for x in lists]
            columns += [pa.array([x], pa.binary()) for x in (_pack(starts), _pack(counts), _pack(steps), _pack(sizes), joined)] + [pa.array([len(order)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc", "part", "digest", "chars", "upper", "marked", "starts", "counts", "steps", "sizes", "words", "n_words"])
            shard += 1


def _ranges(bits: int):
    """(shard, sizes, words) -> a row (range, shard, sizes, words) for each of the ``2**bits`` hash ranges that the shard has words in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sizes, joined in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sizes = _unpack(sizes)
                part = (_hashes(_texts(sizes, joined)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sizes), np.int64)
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
                to = [*cut[1:].tolist(), len(sizes)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[cut]), pa.array(np.full(len(cut), shard)), pa.array([_pack(sizes[a:b]) for a, b in zip(cut.tolist(), to)], pa.binary()),
                    pa.array([joined[ends[a] : ends[b]] for a, b in zip(cut.tolist(), to)], pa.binary()),
                ], names=["range", "shard", "sizes", "words"])

    return run


_NUMBERED = "range long, shard long, ranks binary, n_words long, sizes binary, words binary, seen binary"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range -> each row's words as ranks within the range; at its end a row without a shard that holds the range's words."""
    part, known, seen, rows, size = None, None, np.zeros(0, np.int64), [], 0

    def ranked() -> Iterator[pa.RecordBatch]:
        nonlocal known, seen, rows, size
        words = _texts(np.concatenate([s for _, s, _ in rows]), b"".join(w for _, _, w in rows))
        rank = np.full(len(words), -1, np.int64) if known is None else pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
        fresh = words.filter(pa.array(rank < 0)).dictionary_encode()
        before = 0 if known is None else len(known)
        rank[rank < 0] = before + fresh.indices.to_numpy()
        known = fresh.dictionary if known is None else pa.concat_arrays([known, fresh.dictionary])
        seen = np.concatenate((seen, np.zeros(len(known) - before, np.int64))) + np.bincount(rank, minlength=len(known))
        ends = np.cumsum([0, *(len(s) for _, s, _ in rows)]).tolist()
        out = [(part, d, _pack(rank[a:b])) for (d, _, _), a, b in zip(rows, ends[:-1], ends[1:])]
        rows, size = [], 0
        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))), pa.nulls(len(out), pa.int64()), *(pa.nulls(len(out), pa.binary()) for _ in range(3))],
                                         names=["range", "shard", "ranks", "n_words", "sizes", "words", "seen"])

    def closed() -> Iterator[pa.RecordBatch]:
        if rows:
            yield from ranked()
        if known is not None:
            sizes, joined = _flat(known)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(known)]), *(pa.array([x], pa.binary()) for x in (_pack(sizes), joined, _pack(seen)))],
                                             names=["range", "shard", "ranks", "n_words", "sizes", "words", "seen"])

    for batch in batches:
        for r, shard, sizes, joined in zip(*(batch.column(k) for k in range(4))):
            if r.as_py() != part:
                yield from closed()
                part, known, seen = r.as_py(), None, np.zeros(0, np.int64)
            rows.append((shard.as_py(), _unpack(sizes.as_py()), joined.as_py()))
            size += len(rows[-1][1])
            if size >= PART_WORDS:
                yield from ranked()
    yield from closed()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: its ranges' ranks in order, then the shard itself -> the shard with ``ids`` for local codes."""
    held = []
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        kept = [n for n in batch.schema.names if n not in ("steps", "closing", "range", "before", "ranks")]
        for k in range(batch.num_rows):
            one = {n: batch.column(c)[k] for n, c in at.items()}
            if not one["closing"].as_py():
                held.append(_unpack(one["ranks"].as_py()).astype(np.int64) + one["before"].as_py())
                continue
            starts, steps = _unpack(one["starts"].as_py()).astype(np.int64), _unpack(one["steps"].as_py()).astype(np.int64)
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(steps)))
            codes = total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))
            ids = np.concatenate(held)[codes] if held else codes
            held = []
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]).slice(k, 1) for n in kept), pa.array([_pack(ids)], pa.binary())], names=[*kept, "ids"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, sizes, joined, seen in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = _texts(_unpack(sizes), joined)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(before + np.arange(len(words))), pa.array(_unpack(seen).astype(np.int64))], names=["word", "word_id", "shards"])


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(shards, vocabulary)``: the corpus as CSR shards and its words.

    ``vocabulary``: ``word, word_id`` (dense from 0), ``shards`` (how many hold it).  A shard holds its rows' ``doc``,
    ``part``, ``digest`` of the text, ``chars`` (code points), ``upper`` (``[A-Z]``) and ``marked``, and packed integers
    (see ``_pack``): ``starts`` (row pointers), ``ids`` and ``counts``.  Words are case-sensitive runs of
    ``[^\\x20\\x09-\\x0D]``; a null text reads as empty and has an empty row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(part_col).cast("string").alias("part"), F.col(text_col).cast("string").alias("text"))
    local = materialize(rows.mapInArrow(_local_shards, f"{_ROWS}, steps binary, sizes binary, words binary, n_words long"), "csr-local")
    held = local.agg(F.sum("n_words")).first()[0] or 0
    cut = local.select("shard", "sizes", "words").mapInArrow(_ranges((held // PART_WORDS).bit_length()), "range long, shard long, sizes binary, words binary")
    numbered = materialize(cut.repartition("range").sortWithinPartitions("range", "shard").mapInArrow(_number, _NUMBERED), "dictionary")
    # one row a range: dense ids go on where the range before ends
    offsets = numbered.where("shard is null").select("range", F.coalesce(F.sum("n_words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = materialize(offsets, "offsets")
    vocabulary = numbered.where("shard is null").join(offsets, "range").select("before", "sizes", "words", "seen").mapInArrow(_listed, "word string, word_id long, shards long")
    back = numbered.where("shard is not null").join(offsets, "range").select("shard", F.lit(0).alias("closing"), "range", "before", "ranks")
    both = back.unionByName(local.drop("sizes", "words", "n_words").withColumn("closing", F.lit(1)), allowMissingColumns=True)
    shards = both.repartition("shard").sortWithinPartitions("shard", "closing", "range").mapInArrow(_encode, f"{_ROWS}, ids binary")
    shards = materialize(shards, "csr")
    release(local)
    return shards, vocabulary


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CSR shards -> a row per document with row sum and non-zero count."""
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            starts, counts = (_unpack(batch.column(at[n])[k].as_py()) for n in ("starts", "counts"))
            ids = _unpack(batch.column(at["ids"])[k].as_py())
            if len(ids) != len(counts) or len(ids) != int(starts[-1]):
                raise ValueError("a shard's ids, counts and row pointers differ in length")
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))
            starts = starts.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n])[k].values for n in ("doc", "part", "digest", "chars", "upper", "marked")),
                                              pa.array(sums[starts[1:]] - sums[starts[:-1]]), pa.array(np.diff(starts))],
                                             names=["doc", "part", "digest", "chars", "upper", "marked", "words", "distinct_words"])


def failures(shards: DataFrame, least_words: int = 100, distinct_pct: int = 80, upper_pct: int = 10) -> DataFrame:
    """``(doc, part, mask)`` per document: bit k of ``mask`` is set where it fails filter ``FILTERS[k]``.

    A: fewer than ``least_words`` words.  B: distinct words below ``distinct_pct`` per cent of words.  C: capitals
    above ``upper_pct`` per cent of code points.  D: holds one of ``MARKS``.  E: its text is that of a smaller id.
    A null id is no smaller id and has none; rows that repeat an id do not fail E by one another.  A null part is the empty one.
    """
    rows = shards.mapInArrow(_row_counts, "doc long, part string, digest binary, chars long, upper long, marked boolean, words long, distinct_words long")
    checks = (f"words < {least_words}", f"100 * distinct_words < {distinct_pct} * words", f"100 * upper > {upper_pct} * chars", "marked")
    rows = rows.select("doc", F.coalesce("part", F.lit("")).alias("part"), "digest", F.expr(" + ".join(f"if({c}, {1 << k}, 0)" for k, c in enumerate(checks))).alias("mask"))
    rows = materialize(rows, "masks")
    # cut from its aggregation: a join of two plain shuffles is one whose hot groups of copies can be split
    first = materialize(rows.groupBy("digest").agg(F.min("doc").alias("first")), "first")
    return rows.join(first, "digest").select("doc", "part", (F.col("mask") + F.when(F.col("doc") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))


def interactions(failed: DataFrame, labels: DataFrame, filters: str = FILTERS, label_id: str = "doc_id") -> DataFrame:
    """What each filter does at each step of every order: one row per part, order and step, zeros included.

    ``failed`` is ``(doc, part, mask)`` with a bit per filter.  A document goes at its first failing filter.  Labels of one id
    count together (any row with quality 1, any with toxic 1); ids without labels, null ids and null labels lose nothing.
    """
    marks = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc")).agg(
        F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"))
    held = failed.join(marks, "doc", "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    orders = [("".join(p), k + 1, 1 << filters.index(p[k]), sum(1 << filters.index(x) for x in p[:k])) for p in permutations(filters) for k in range(len(filters))]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(own).alias("own"), F.lit(past).alias("past")) for o, k, own, past in orders])
    x = held.withColumn("s", F.explode(steps)).select("part", "mask", "good", "toxic", "n", "s.*")
    fails, gone = "mask & own <> 0", "mask & past <> 0"
    here = f"{fails} and not ({gone})"

    def total(cond: str, what: str = "n"):
        return F.sum(F.expr(f"if({cond}, {what}, 0L)"))

    # a document that fails f filters goes by each of them in one f-th of all orders
    share = len(orders) // len(filters)
    return x.groupBy("part", "filter_order", "step").agg(
        total("mask & (past | own) = 0").alias("kept"), total(here).alias("removed"), total(f"{fails} and {gone}").alias("redundant"), total("mask = own").alias("unique_fails"),
        total(f"{here} and good = 1").alias("good_lost"), total(f"{here} and toxic = 1").alias("toxic_lost"), total(fails, f"n * {share} div bit_count(mask)").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of the five filters over whole texts; an empty ``docs`` has no parts and gives no rows.

    Repeated rows count each.  Other columns, whatever their names, are ignored.
    """
    shards, _ = term_matrix(docs, id_col, text_col, part_col)
    return interactions(failures(shards), labels, label_id=id_col)


def oracle() -> str:
    """DuckDB: every document under every order, filter by filter, without masks or shares."""
    return """
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
c as (select *, min(doc_id) over (partition by text) as first from w),
f as (select c.doc_id, part, unnest([
    struct_pack(name := 'A', fails := len(w) < 100), struct_pack(name := 'B', fails := 100 * len(list_distinct(w)) < 80 * len(w)),
    struct_pack(name := 'C', fails := 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)),
    struct_pack(name := 'D', fails := regexp_matches(text, '[#$%&*|]')), struct_pack(name := 'E', fails := coalesce(c.doc_id > first, false))], recursive := true) from c),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order from letter a, letter b, letter c, letter d, letter e
      where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, unnest(range(1, 6))::int as step from o),
lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
d as (select f.doc_id, part, string_agg(case when fails then name else '' end, '' order by name) as failed, coalesce(any_value(good), 0) as good, coalesce(any_value(toxic), 0) as toxic
      from f left join lab using (doc_id) group by f.doc_id, part),
x as (select part, filter_order, step, failed, good, toxic, substr(filter_order, step, 1) as own,
             contains(failed, substr(filter_order, step, 1)) as fails, translate(failed, substr(filter_order, 1, step - 1), '') <> failed as gone
      from d, s),
r as (select part, filter_order, step, own, count(*) filter (not fails and not gone) as kept, count(*) filter (fails and not gone) as removed, count(*) filter (fails and gone) as redundant,
             count(*) filter (failed = own) as unique_fails, count(*) filter (fails and not gone and good = 1) as good_lost, count(*) filter (fails and not gone and toxic = 1) as toxic_lost
      from x group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r"""
