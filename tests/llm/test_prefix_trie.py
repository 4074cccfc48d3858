"""Prefix trie against the DuckDB twin and a plain dictionary of prefixes."""
import hashlib
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netlake.llm import prefix_trie, queries
from netlake.plans.stage import materialize
from netlake.session import ship_package

SF = "/root/testdata/sf0.01"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def sp(spark):
    ship_package(spark)
    return spark


def rebuilt(rows):
    """rows (conv, turn, role, text) without equal turn numbers in a conversation -> conv -> turns."""
    own = {}
    for c, n, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((r or "", t or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []

    def walk(k):
        leaves, saved = (0, 0) if k in kids else (1, 0)
        for x in kids.get(k, ()):
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        saved += (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        ends = sorted(c for c in nodes[k] if len(convs[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids.get(k, ())), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if nodes:
        walk(())
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def test_query_equals_twin_and_plain_trie(sp):
    got = listed(queries.QUERIES["op12_prefix_trie"](sp, SF))
    conv = pd.read_parquet(f"{SF}/conversations.parquet")
    assert got == plain(rebuilt(conv.itertuples(index=False, name=None)))
    db = duckdb.connect()
    db.register("conversations", conv)
    assert got == sorted((tuple(None if x is pd.NA else x for x in r) for r in db.sql(queries.ORACLES["op12_prefix_trie"]).select(*COLS).fetchall()), key=repr)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_long_and_copied_conversations(sp, monkeypatch, width):
    """Blocks and scan buckets far shorter than the conversations; copies, prefixes of one another, branches after long shared runs."""
    monkeypatch.setattr(prefix_trie, "TURNS", 4)
    monkeypatch.setattr(prefix_trie, "BLOCKS", 2)
    rows = []
    for c in range(60):
        n, branch = 1 + c % 40, c % 7
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {t} " + "x" * (t % 5) + (f" of {branch}" if t > 11 + c % 3 else "")) for t in range(n)]
    rows += [(100, t, "user", f"turn {t}") for t in range(2)] + [(105, t, "user", f"turn {t}") for t in range(9)]
    df = sp.createDataFrame(rows, "conv_id long, turn long, role string, text string").orderBy(F.rand(3))
    assert listed(prefix_trie.conversation_trie(df, width=width)) == plain(rebuilt(rows))


def test_odd_rows(sp):
    """Null and empty fields, negative and null ids, absent leads, turnless conversations, very long texts."""
    long_ = "né " * 100_000
    rows = [(0, None, None, None), (0, 1, "a", ""), (0, 2, "", "a"), (0, 3, "b", long_), (7, 0, "a", "x"), (-5, 0, None, "x"), (-5, 4, "z", None), (250, 0, "q", "only"), (251, 9, "q", "only"), (301, 0, "r", "s"), (None, 0, "n", "n"), (9_000_000_000, 1, "a", "x"),
            (301, 1, "r", "s"), (301, 2, "r", "s"), (301, 3, "r", "s"), (301, 4, "r", "s"), (301, 5, "r", "s")]
    convs = rebuilt([r for r in rows if r[0] != -5])
    neg = [(None or "", "x"), ("z", "")]
    h = zlib.crc32(b"-5") % 6
    lead = [("", ""), ("a", ""), ("", "a"), ("b", long_)]  # -5 - (-5 % 100) is 0 where the remainder has the sign of its left side
    convs[-5] = lead[:h] + neg[h:]
    df = sp.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, t1 int")
    got = listed(prefix_trie.conversation_trie(df))
    assert got == plain(convs)
    assert listed(prefix_trie.conversation_trie(df.where("conv_id is null"))) == []


def test_ties_and_repeated_rows_are_turns_in_order_of_their_digest(sp):
    rows = [(0, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, "b", "y")]
    df = sp.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = sorted([("a", "x"), ("a", "x"), ("b", "y")], key=lambda x: hashlib.md5(f"{len(x[0])}:{x[0]}{x[1]}".encode()).hexdigest())
    assert listed(prefix_trie.conversation_trie(df)) == plain({0: turns})


def test_ends_hash_of_many_runs(sp):
    """One key over many partitions and Arrow batches hashes like one joined text."""
    rows = materialize(sp.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).otherwise(F.lit("hot")).alias("key"), (F.lit(20_000) - F.col("id")).alias("conv_id")), "ends")
    got = dict(prefix_trie.joined_ids_sha256(rows).collect())
    ids = sorted(20_000 - i for i in range(40_000) if i % 100)
    assert got["hot"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and len(got) == 401
