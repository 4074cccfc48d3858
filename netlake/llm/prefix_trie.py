"""Conversation prefix trie by Spark SQL ROLLUP over positional turn ids.

A conversation's turns become ids (a digest of role and text, with the text's length) and are cut into
blocks of ``WIDTH`` positions.  A block row holds them as columns ``t1 .. t8`` beside the key of the node
where the block starts: the *prior block's node*.  One ``GROUP BY block, prior node, ROLLUP(t1, ..., t8)``
aggregates all prefixes of all conversations together; ``grouping_id()`` tells a row's depth within its block.  Node keys are
the depth and two sums of 64-bit hashes of (position, turn id): a running sum over a conversation's blocks gives
every block its prior key, so long conversations need no loop over blocks.

Subtree totals need no walk over the tree either.  A conversation represents the nodes whose smallest member it is:
from some depth on all of its path.  Distinct text below a node is therefore a sum over the node's members of
what each represents, leaves are a sum over members that represent a childless node, and both are
measures of a second ROLLUP.

Scale.  Texts are read once and only digests move.  Positions and prior keys are running sums split into buckets
within a conversation (``plans.scan``), so a conversation with a third of all turns is spread; ROLLUP is pre-aggregated.  The ids
of the conversations that end at a node are joined to text in parallel runs; only those runs pass, in order, through the
task that takes their SHA-256.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import BUCKET_COL, keyed_scan
from ..plans.stage import materialize, release

WIDTH = 8
#: Turns and blocks of one conversation that are ordered together.
TURNS, BLOCKS = 4096, 512
#: Sorts before every other turn number.
NULL_TURN = -(1 << 62)
EMPTY = sha256(b"").hexdigest()


def _hash(seed: int, pos, tid):
    return F.xxhash64(F.lit(seed), pos.cast("long"), tid).cast("decimal(20,0)")


def _chars(tid):
    return F.substring_index(tid, ":", -1).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, tid)``: turns in order of ``turn``, null first, numbered from 1; equal turn numbers go by id.

    Null roles and texts are empty; rows of a null ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    tid = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lit(":"), F.length(text).cast("string"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NULL_TURN)).alias("turn"), tid.alias("tid"))
    turns = materialize(turns, "turns")
    return keyed_scan(turns, ["conv_id"], "turn", "tid", TURNS, sums=[("pos", F.lit(1))]).select("conv_id", "pos", "tid")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c led by the first h turns of conversation ``c - c % group``, then its own after its first h; ``h = crc32(c) % most``.

    One row ``(conv_id, pos, tid)`` per rebuilt turn and, for each conversation, one with position 0 and no turn.
    A lead of fewer turns is taken whole; where there is none, the conversation loses its first h turns.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("base", F.expr(f"conv_id - conv_id % {group}")).withColumn("h", F.expr(f"crc32(cast(conv_id as string)) % {most}"))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "tid")
    lens = heads.groupBy("base").agg(F.max("pos").alias("held"))
    convs = materialize(convs.join(lens, "base", "left").withColumn("led", F.least("h", F.coalesce("held", F.lit(0)))), "convs")
    led = convs.join(heads, "base").where("pos <= led").select("conv_id", "pos", "tid")
    own = turns.join(convs.select("conv_id", "h", "led"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "tid")
    return led.unionByName(own).unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("tid")))


def turn_blocks(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(conv_id, block, t1 .. , s1, s2, chars, last, p1, p2, before)``: blocks with their own key sums, characters and last position, and those of all earlier blocks."""
    x = turns.withColumn("block", F.expr(f"cast(greatest(pos - 1, 0) div {width} as long)")).withColumn("slot", F.expr(f"(pos - 1) % {width} + 1"))
    held = F.col("tid").isNotNull()

    def total(e):
        return F.coalesce(F.sum(F.when(held, e)), F.lit(0)).cast("decimal(38,0)")

    rows = x.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("slot") == j, F.col("tid"))).alias(f"t{j}") for j in range(1, width + 1)],
                                             total(_hash(1, F.col("pos"), F.col("tid"))).alias("s1"), total(_hash(2, F.col("pos"), F.col("tid"))).alias("s2"),
                                             total(_chars(F.col("tid"))).cast("long").alias("chars"), F.max("pos").alias("last"))
    rows = materialize(rows, "blocks")
    out = keyed_scan(rows, ["conv_id"], "block", "block", BLOCKS, sums=[("p1", F.col("s1")), ("p2", F.col("s2")), ("before", F.col("chars"))]).drop(BUCKET_COL)
    return materialize(out.withColumn("p1", F.col("p1") - F.col("s1")).withColumn("p2", F.col("p2") - F.col("s2")).withColumn("before", F.col("before") - F.col("chars")), "blocks")


def roll_up(blocks: DataFrame, measures: str, width: int = WIDTH) -> DataFrame:
    """All prefixes at once: ``(depth, k1, k2, q1, q2, before, chars)`` (node key, parent key, characters above the last turn, of it) and ``measures``."""
    t = ", ".join(f"t{j}" for j in range(1, width + 1))
    rows = blocks.sparkSession.sql(f"""
        select block, p1, p2, {t}, {width} - bit_count(grouping_id()) as level, max(before) as above, {measures}
        from {{blocks}} group by block, p1, p2, rollup({t})""", blocks=blocks)
    ids = [F.when(F.col("level") >= j, F.col(f"t{j}")) for j in range(1, width + 1)]
    rows = rows.withColumn("tid", F.coalesce(*[F.when(F.col("level") == j, F.col(f"t{j}")) for j in range(1, width + 1)]))
    # a null at the deepest grouped position is a conversation that had already ended there
    rows = rows.where("tid is not null or (level = 0 and block = 0)").withColumn("depth", F.col("block") * width + F.col("level"))

    def sums(seed: int, upto: int):
        own = [F.coalesce(F.when(F.col("level") >= j + upto, _hash(seed, F.col("block") * width + j, F.col(f"t{j}"))), F.lit(0)) for j in range(1, width + 1)]
        return sum(own[1:], F.col(f"p{seed}") + own[0]).cast("decimal(38,0)")

    above = sum((F.coalesce(F.when(F.col("level") > j, _chars(ids[j - 1])), F.lit(0)) for j in range(1, width)), F.col("above"))
    extra = [c for c in rows.columns if c not in ("block", "p1", "p2", "level", "above", "tid", "depth", *(f"t{j}" for j in range(1, width + 1)))]
    return rows.select("depth", sums(1, 0).alias("k1"), sums(2, 0).alias("k2"), sums(1, 1).alias("q1"), sums(2, 1).alias("q2"), above.alias("above"), F.coalesce(_chars(F.col("tid")), F.lit(0)).alias("chars"), *extra)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) -> one row (key, first id, ids joined by commas) per key and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        cut = np.flatnonzero(np.concatenate(([True], np.asarray(keys[1:].to_numpy(zero_copy_only=False) != keys[:-1].to_numpy(zero_copy_only=False), bool))))
        ids = batch.column(1).to_pylist()
        ends = [*cut[1:].tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(cut)), pa.array([ids[a] for a in cut.tolist()], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cut.tolist(), ends)])], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (key, first id) -> (key, sha); one digest is open at a time."""
    key, h = None, None
    for batch in batches:
        keys, shas = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if k == key:
                h.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    shas.append(h.hexdigest())
                key, h = k, sha256()
            h.update(ids.as_py().encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shas)], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])


def joined_ids_sha256(rows: DataFrame) -> DataFrame:
    """``(key, conv_id)`` -> ``(key, ends_sha256)``: SHA-256 of each key's ids, ascending, comma-joined."""
    runs = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key string, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")


def trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """Trie of all conversations of ``turns(conv_id, pos, tid)`` (with a row of position 0 for each), one row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.  No conversations: no rows, not even a root.
    """
    blocks = turn_blocks(turns, width)
    key = ["depth", "k1", "k2"]
    whole = blocks.groupBy("conv_id").agg(F.sum("chars").alias("total"), F.max("last").alias("depth"), F.sum("s1").cast("decimal(38,0)").alias("k1"), F.sum("s2").cast("decimal(38,0)").alias("k2"))
    whole = materialize(whole, "whole")
    nodes = materialize(roll_up(blocks, "min(conv_id) as conv_id", width), "nodes")
    children = materialize(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children")), "children")
    heads = nodes.join(children, key, "left").groupBy("conv_id").agg(F.min(F.struct("depth", "above")).alias("top"), F.max(F.when(F.col("n_children").isNull(), 1).otherwise(0)).alias("leaf"))
    stats = whole.join(heads, "conv_id", "left").select("conv_id", "total", F.coalesce(F.col("total") - F.col("top.above"), F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    rows = blocks.join(materialize(stats, "stats"), "conv_id")
    full = roll_up(rows, "count(*) as n_convs, sum(total) as total, sum(own) as own, sum(leaf) as n_leaves, min(struct(conv_id, total, own)) as head", width)
    # all text of the members from here on, less each distinct node's text once
    saved = F.expr("(total - n_convs * above) - (own - head.own + head.total - above)")
    full = full.select(*key, "q1", "q2", F.col("head.conv_id").alias("conv_id"), "n_convs", "n_leaves", saved.alias("saved_tokens"))
    ends = joined_ids_sha256(whole.select(F.concat_ws(":", *key).alias("key"), "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(children, key, "left").join(parents, ["depth", "q1", "q2"], "left").withColumn("key", F.concat_ws(":", *key)).join(ends, "key", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                      F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6, width: int = WIDTH) -> DataFrame:
    """``trie`` of the rebuilt conversations (see ``numbered_turns``, ``rebuilt_turns``).

    Repeated rows are turns of their own.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    turns = materialize(numbered_turns(conversations.select("conv_id", "turn", "role", "text")), "numbered")
    built = materialize(rebuilt_turns(turns, group, most), "rebuilt")
    release(turns)
    return trie(built, width)


def oracle() -> str:
    """DuckDB: prefixes listed for every conversation, subtrees by joining each node's representative with all of its prefixes."""
    return """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint)),
            lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: xor(v >> 1, case when v & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 6 as h
      from (select distinct conv_id from t)),
led as (select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h),
m as (select conv_id, count(*) as led from led group by conv_id),
r as (select * from led union all
      select t.conv_id, t.pos - c.h + coalesce(m.led, 0), t.role, t.text from t join c using (conv_id) left join m using (conv_id) where t.pos > c.h),
l as (select conv_id, list(md5(length(role)::varchar || ':' || role || text) order by pos) as ids, list(length(text) order by pos) as lens from r group by conv_id
      union all select conv_id, [], [] from c where conv_id not in (select conv_id from r)),
p as (select conv_id, d, len(ids) as n, array_to_string(ids[1:d], ',') as key, case when d = 0 then null else array_to_string(ids[1:d - 1], ',') end as up, case when d = 0 then 0 else lens[d] end as chars
      from (select *, unnest(range(0, len(ids) + 1)) as d from l)),
v as (select d, key, any_value(up) as up, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256 from p group by d, key),
k as (select d - 1 as d, up as key, count(*) as n_children from v where d > 0 group by 1, 2),
w as (select v.*, coalesce(n_children, 0) as n_children from v left join k using (d, key)),
s as (select p.d, p.key, sum((w.n_convs - 1) * w.chars)::bigint as saved_tokens, count(*) filter (w.n_children = 0) as n_leaves
      from w join p on p.conv_id = w.conv_id and p.d <= w.d group by p.d, p.key)
select w.conv_id, w.d::bigint as depth, a.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
from w join s using (d, key) left join v a on a.d = w.d - 1 and a.key = w.up"""
