"""Document fingerprints by SpotSigs.

A spot is a common word (anchor) and the chain of the next ``CHAIN`` content words
behind it; a document's fingerprint is its set of distinct spots (32-bit hashes), headed
by their number.  Likeness is the Jaccard coefficient of two sets, pruned by their
sizes: sets of ``a < b`` spots cannot be more alike than ``a / b``.  For the join of all
documents, spot sets are partitioned by length so that similar sets lie in the same or in
neighbouring partitions, and rare spots are compared first.

Words are runs of letters, A-Z lower-cased.  A text without any spot is known by one
hash of its words (or, without words, of its bytes) instead.
"""
from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize
from .textops import LOWER, blocks, buffers, mix, span_hash, word_spans

CHAIN = 2
#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = """a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was were which with you
aber als an auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nach nicht sich sie sind und von war wie wird zu zum
au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se son sur un une vous
al como con de del el ella en es esta este la las lo los más no o para pero por que se ser sin son su sus un una y ya""".split()
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data, off = buffers(pa.array(words))
    return span_hash(data[: off[-1]], off[:-1], off[1:])


_ANCHOR = np.sort(np.unique(_hash_words(ANCHORS)))


def spot_sets(data: np.ndarray, off: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """Each text's sorted distinct spots as unsigned 32-bit integers; one hash of the whole where there are none."""
    low = LOWER[data]
    s, e, ptr = word_spans(_LETTER[low], off)
    h = span_hash(low, s, e)
    at = np.searchsorted(_ANCHOR, h)
    at[at == len(_ANCHOR)] = 0
    anchor = _ANCHOR[at] == h
    content = np.flatnonzero(~anchor)
    rank = np.cumsum(~anchor)  # content words up to and with this one
    a = np.flatnonzero(anchor)
    first = rank[a]
    ok = first + chain <= len(content)
    a, first = a[ok], first[ok]
    doc = np.searchsorted(ptr, a, "right") - 1
    if len(a):
        ok = content[first + chain - 1] < ptr[doc + 1]
        a, first, doc = a[ok], first[ok], doc[ok]
    spot = mix(h[a])
    for k in range(chain):
        spot = mix(spot + h[content[first + k]])
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (spot >> np.uint64(32)))
    cut = np.searchsorted(key, np.arange(len(off), dtype=np.uint64) << np.uint64(32))
    spots = key.astype(np.uint32)
    out = []
    for d in range(len(off) - 1):
        x = spots[cut[d] : cut[d + 1]]
        if not len(x) and off[d + 1] > off[d]:
            whole = h[ptr[d] : ptr[d + 1]].tobytes() or data[off[d] : off[d + 1]].tobytes()
            x = np.frombuffer(hashlib.blake2b(whole, digest_size=4).digest(), np.uint32)
        out.append(x)
    return out


def fingerprint(spots: np.ndarray) -> str:
    """``<number of spots>:<base64 of the sorted spots>``; the empty text is ``0:``."""
    return f"{len(spots)}:{b64encode(spots.astype('<u4').tobytes()).decode()}"


def spots_of(mark: str) -> np.ndarray:
    return np.frombuffer(b64decode(mark.partition(":")[2]), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two spot sets; 0 when their sizes already rule out ``least``.  Two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return n / (len(both) - n)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order, each bucket closed by a copy of the next bucket's first row: fingerprints of text, edited text and neighbour."""
    held = None  # the last row, whose neighbour is still to come

    def out(rows: list[tuple[int, str, str]]) -> Iterator[pa.RecordBatch]:
        size = np.concatenate(([0], np.cumsum([len(t) * 4 + len(n) for _, t, n in rows])))
        for i, j in blocks(size, 6 << 20):
            part = rows[i:j]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in part]
            data, off = buffers(pa.array([x for r, e in zip(part, edited) for x in (r[1], r[2], e)], pa.string()))
            sets = spot_sets(data[: off[-1]], off)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in part], pa.int64()), pa.array([len(r[1]) for r in part], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([fingerprint(x) for x in sets[::3]]), pa.array([fingerprint(x) for x in sets[2::3]]),
                pa.array([likeness(x, y) for x, y in zip(sets[::3], sets[2::3])]), pa.array([likeness(x, y) for x, y in zip(sets[::3], sets[1::3])]),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        rows = []
        for bucket, copy, doc, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if held is not None and held[0] == bucket:
                rows.append((held[1], held[2], text))
            held = None if copy else (bucket, doc, text)
        if rows:
            yield from out(rows)


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many
    (or all) of the next row by descending id (after the last, the first; a single row is its own
    next).  A null text reads as empty.  Rows of a null id come last; rows of one id follow each
    other by descending text; other columns are ignored; an empty table gives no rows.

    Texts move once, to range buckets by id; of each bucket its first row is also sent to the bucket before.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select(F.col("doc_id").cast("double").alias("doc_id"))
    edges = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    edges = edges or [0.0]
    # bucket 0 holds the largest ids, the last one the smallest and the null ids
    split = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="key", outputCol="low", handleInvalid="keep")
    placed = split.transform(rows.withColumn("key", F.col("doc_id").cast("double")))
    placed = placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(len(edges) - F.col("low").cast("int")))
    firsts = {r.bucket: r.m for r in placed.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("m")).collect()}  # one row a bucket
    order = sorted(firsts)
    send = {firsts[b]: order[i - 1] for i, b in enumerate(order)}  # the overall first goes to the last bucket
    also = F.create_map(*[x for k, v in send.items() if k is not None for x in (F.lit(k), F.lit(v))]) if any(k is not None for k in send) else F.create_map().cast("map<bigint,int>")
    copied = F.when(F.col("doc_id").isNull(), F.lit(send.get(None)).cast("int")).otherwise(also[F.coalesce("doc_id", F.lit(0))])
    targets = F.filter(F.array(F.struct("bucket", F.lit(0).alias("copy")), F.struct(copied.alias("bucket"), F.lit(1).alias("copy"))), lambda x: x["bucket"].isNotNull())
    sent = placed.select(F.explode(targets).alias("go"), "doc_id", "text").select("go.bucket", "go.copy", "doc_id", "text")
    sent = sent.repartition(max(1, len(order)), "bucket").sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), F.desc("text"))
    return sent.mapInArrow(_edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        for i, j in blocks(off):
            sets = spot_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                                              pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "mark", "spots"])


def similar_documents(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(pairs, classes)``: pairs ``(a, b, likeness)`` of class representatives with likeness at or above ``least``, ``a < b``, and ``(doc_id, class_id)`` per row.

    Documents with equal spot sets are one class (all alike) whose smallest id represents it.  Classes fall
    into length partitions whose upper end is ``1 / least`` times the lower one; two classes meet
    where they share one of their rarest spots in the same or in neighbouring partitions, within the
    sizes that ``least`` allows, and are then compared exactly.  An empty text is a class of its own and pairs with
    nothing; a row of a null id is in its texts' class, but a null represents none: a class of null ids alone has a null
    ``class_id`` and no pairs.  Repeated rows stay; other columns are ignored; an empty table gives empty results.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(_spots, "doc_id long, mark binary, spots array<long>"), "spots")
    held = rows.where("size(spots) > 0").groupBy("mark").agg(F.min("doc_id").alias("a"), F.min_by("spots", "doc_id").alias("spots"))
    held = materialize(held, "classes")
    classes = rows.select("doc_id", "mark", (F.size("spots") > 0).alias("some")).join(held.select("mark", "a"), "mark", "left").select(
        "doc_id", F.when(F.col("some"), F.col("a")).otherwise(F.col("doc_id")).alias("class_id"))
    sets = held.where("a is not null").select("a", "spots")
    band = f"cast(floor(ln(size(spots)) / -ln({least})) as int)"
    each = sets.select("a", F.expr(band).alias("band"), F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    seen = materialize(each.groupBy("spot").agg(F.count("*").alias("seen")).where("seen > 1"), "seen")
    ranked = each.join(seen, "spot", "left").groupBy("a", "band", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "spot"))).alias("s"))
    first = ranked.select("a", "band", "n", F.posexplode(F.expr(f"slice(s, 1, n - cast(ceil(n * {least}) as int) + 1)")).alias("place", "s")).where("s.seen > 1").select("a", "band", "n", "place", "s.spot")
    first = materialize(first, "first")
    x, y = first.alias("x"), first.withColumn("band", F.explode(F.expr("array(band - 1, band)"))).alias("y")
    near = x.join(y, F.expr(f"x.spot = y.spot and x.band = y.band and (x.n, x.a) < (y.n, y.a) and x.n >= {least} * y.n and (least(x.n - x.place, y.n - y.place)) * (1 + {least}) >= {least} * (x.n + y.n)"))
    pairs = near.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()
    both = pairs.join(sets.withColumnRenamed("spots", "s1"), "a").join(sets.select(F.col("a").alias("b"), F.col("spots").alias("s2")), "b")
    both = both.withColumn("n", F.size(F.array_intersect("s1", "s2"))).withColumn("likeness", F.col("n") / (F.size("s1") + F.size("s2") - F.col("n")))
    return both.where(f"likeness >= {least}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), classes
