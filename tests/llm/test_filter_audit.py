"""Filter audit against the DuckDB twin and a plain loop over all orders."""
import re
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest

from netlake.llm import filter_audit, queries
from netlake.session import ship_package

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sp(spark):
    ship_package(spark)
    return spark


def plain(rows, labels):
    """rows (doc, text, lang), labels (doc, quality, toxic) -> {(part, order, step): counts}."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    fails = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails.append((d, lang or "", {k for k, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), d is not None and d > least[t])) if x}))
    out = {}
    for part in {p for _, p, _ in fails}:
        docs = [(d, f) for d, p, f in fails if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(o, 1):
                here = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                removed[x] += len(here)
                out[part, "".join(o), step] = [len(left), len(here), sum(x in f for _, f in docs) - len(here), sum(f == {x} for _, f in docs), sum(d in good for d in here), sum(d in toxic for d in here), x]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = removed[v[-1]]
    return out


def listed(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.toPandas().itertuples()}


def test_query_equals_twin_and_plain_loop(sp):
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    got = listed(queries.QUERIES["op13_filter_audit"](sp, SF))
    assert got == plain(list(zip(docs.doc_id, docs.text, docs.lang)), list(zip(labels.doc_id, labels.quality, labels.toxic)))
    db = duckdb.connect()
    db.register("documents", docs)
    db.register("labels", labels)
    twin = db.sql(queries.ORACLES["op13_filter_audit"]).df()
    assert got == {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in twin.itertuples()}


ODD = [(1, None, None), (2, "", "en"), (3, " \n\t ", ""), (4, "The quick brown fox " * 20_000, "en"), (5, "the cat", "en"), (5, "the cat", "en"), (6, "the cat", "fr"), (None, "the cat", "fr"), (None, "A & B", None),
       (7, "Été É " * 60, "fr"), (8, "A" * 11 + "b" * 89 + " " * 10, "en"), (9, " ".join(f"w{i}" for i in range(100)), "en"), (10, " ".join(f"w{i}" for i in range(99)), "en"), (11, "x " * 25 + " ".join(f"y{i}" for i in range(79)), "en"), (12, "\x85  a", "en")]


@pytest.mark.parametrize("size", [4 << 20, 16])
def test_odd_rows(sp, monkeypatch, size):
    """Null, empty, blank and very long texts, null and repeated ids, repeated and null labels, in one shard and in many."""
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    monkeypatch.setattr(filter_audit, "PART_WORDS", size)
    labels = [(5, 1, 0), (5, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    docs = sp.createDataFrame([(d, t, p, "m", 0) for d, t, p in ODD], "doc_id long, text string, lang string, mask string, shard int")
    lab = sp.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert listed(filter_audit.audit(docs, lab)) == plain(ODD, labels)


def test_matrix_is_the_corpus(sp):
    """Shards and vocabulary give back each document's word counts; ids are dense."""
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(60)
    shards, words = filter_audit.term_matrix(sp.createDataFrame(docs[["doc_id", "text", "lang"]]))
    words = words.toPandas()
    assert sorted(words.word_id) == list(range(len(words))) and words.word.is_unique
    name = dict(zip(words.word_id, words.word))
    got = {}
    for s in shards.collect():
        starts, ids, counts = (filter_audit._unpack(bytes(x)) for x in (s.starts, s.ids, s.counts))
        for d, a, b in zip(s.doc, starts[:-1], starts[1:]):
            got[d] = {name[i]: c for i, c in zip(ids[a:b].tolist(), counts[a:b].tolist())}
    for d, t in zip(docs.doc_id, docs.text):
        w, c = np.unique(re.findall("[^\x20\x09-\x0d]+", t), return_counts=True)
        assert got[d] == dict(zip(w.tolist(), c.tolist()))


def test_empty_tables(sp):
    none = sp.createDataFrame([], "doc_id long, text string, lang string")
    lab = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, lab).count() == 0
    assert listed(filter_audit.audit(sp.createDataFrame(ODD[:3], "doc_id long, text string, lang string"), lab)) == plain(ODD[:3], [])
