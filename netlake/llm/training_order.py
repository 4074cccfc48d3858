"""Training-order materialisation: a keyed Feistel permutation places every sequence.

Documents (ids and a closing id) follow each other and are cut every ``length`` ids into sequences.
A balanced Feistel network over the smallest even number of bits that holds the ``n`` sequence
numbers, applied again while a value falls outside (cycle-walking), is a permutation of
0..n-1: each sequence gets a global slot from the key alone, without a sort or a table.
Shards hold ``shard`` slots each, as records of one fixed size, so slot ``s`` lies at byte
``(s mod shard) * stride`` of file ``s div shard``; reads are sequential and resume anywhere.

Scale.  Ids are written once; a document's place is its place within its task plus the ids of
earlier tasks (one row a task).  Slices of sequences then move once, to their shard.
"""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import materialize
from .textops import mix, mix_one
from .tokens import tokeniser

LENGTH, SHARD, KEY, ROUNDS = 2048, 4096, 20240607, 6


def feistel(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse) at ``x``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(mix_one(key * 1000 + r)) for r in range(ROUNDS)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        a, b = v >> h, v & mask
        for k in keys[::-1] if back else keys:
            a, b = (b ^ (mix(a + k) & mask), a) if back else (b, a ^ (mix(b + k) & mask))
        v = (a << h) | b
        out[todo] = v
        todo = todo[v >= n]
    return out.astype(np.int64)


def _encode(files: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = tokeniser(*files), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tok.ids(text.as_py()), np.uint32(0))
                if int(ids.max()) > 65535:
                    raise ValueError("records hold ids of 16 bits; this vocabulary has larger ones")
                ids = ids.astype("<u2")
                rows.append((doc, task, seen, len(ids), ids.tobytes()))
                seen += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.binary()))], names=["doc_id", "task", "start", "n", "ids"])

    return run


def _slice(length: int, total: int, n: int, key: int):
    """(doc, start, n, ids) at global places -> (slot, sequence_id, at, doc_id, ids) per sequence touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            first, last = start // length, (start + size - 1) // length
            reps = last - first + 1
            row = np.repeat(np.arange(len(start)), reps)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps) + first[row]
            a = np.maximum(seq * length, start[row])
            b = np.minimum((seq + 1) * length, start[row] + size[row])
            ids = batch.column(3)
            cut = [ids[r].as_buffer()[2 * x : 2 * y].to_pybytes() for r, x, y in zip(row.tolist(), (a - start[row]).tolist(), (b - start[row]).tolist())]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(feistel(seq, n, key)), pa.array(seq), pa.array(a - seq * length), batch.column(0).take(pa.array(row)), pa.array(cut, pa.binary())],
                                                 names=["slot", "sequence_id", "at", "doc_id", "ids"])

    return run


def _records(length: int, shard: int):
    """Slices sorted by (slot, at) -> one record per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride, slot, seq, docs, parts = 2 * length + 1, None, 0, [], []

        def record() -> tuple:
            data = b"".join(parts)
            body = data.ljust(2 * length, b"\0") + b"\n"
            return slot, seq, slot // shard, slot % shard * stride, len(data) // 2, crc32(body), docs, body

        for batch in batches:
            out = []
            for s, q, _, d, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if s != slot:
                    if slot is not None:
                        out.append(record())
                    slot, seq, docs, parts = s, q, [], []
                docs.append(d)
                parts.append(ids)
            if out:
                yield _batch(out)
        if slot is not None:
            yield _batch([record()])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "record_crc32", "doc_ids", "record"])


def training_records(docs: DataFrame, files: tuple, length: int = LENGTH, shard: int = SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence, dealt to shards by slot and sorted within: ``slot, sequence_id, shard, byte_offset, n_tokens, record_crc32, doc_ids, record``.

    ``record`` is ``length`` little-endian 16-bit ids (zero-filled at the corpus's end) and a
    line end; the vocabulary must have at most 65,536 ids.  A null or empty text is its closing id
    alone; rows of null or repeated ids are placed each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = materialize(rows.mapInArrow(_encode(files), "doc_id long, task long, start long, n long, ids binary"), "ids")
    tasks = ids.groupBy("task").agg(F.sum("n").alias("held"))
    base = tasks.select("task", F.coalesce(F.sum("held").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a task
    total = tasks.agg(F.sum("held")).first()[0] or 0
    n = -(-total // length)
    placed = ids.join(F.broadcast(base), "task").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n", "ids")
    cut = placed.mapInArrow(_slice(length, total, n, key), "slot long, sequence_id long, at long, doc_id long, ids binary")
    shards = max(1, -(-n // shard))
    dealt = cut.repartitionByRange(shards, F.floor(F.col("slot") / shard)).sortWithinPartitions("slot", "at")
    return dealt.mapInArrow(_records(length, shard), "slot long, sequence_id long, shard long, byte_offset long, n_tokens long, record_crc32 long, doc_ids array<long>, record binary")


def write_shards(records: DataFrame, path: str) -> None:
    """Write ``records`` as one raw file per shard below ``path/shard=<number>``, through Spark's committing text writer.

    A record's last byte is the line end that the writer adds, so records stand at fixed strides.
    """
    body = records.select("shard", F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value"))
    body.write.mode("overwrite").partitionBy("shard").text(path)


def read_slots(spark: SparkSession, path: str, first: int, count: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``(slot, ids)`` of the slots from ``first`` on, reading only the shards that hold them."""
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("shard").between(first // shard, (first + count - 1) // shard))
    at = files.select("shard", "content", F.explode(F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1)).alias("i"))
    at = at.withColumn("slot", F.col("shard") * shard + F.col("i")).where(F.col("slot").between(first, first + count - 1))
    return at.select("slot", F.expr(f"substring(content, i * {stride} + 1, {stride - 1})").alias("ids"))
