"""Null and repeated ids, clashing names and white space: line dedup, n-gram join and the pipeline against plain loops."""
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netlake.llm import line_dedup, ngram_jaccard
from netlake.session import ship_package

SF = "/root/testdata/sf0.01"
T = "the quick brown fox jumps over the lazy dog and runs away from here today "


@pytest.fixture(scope="module")
def sp(spark):
    ship_package(spark)
    return spark


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def groups(texts, width, num, den):
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t, width) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


ROWS = [(7, T + "a"), (7, T + "a"), (None, T + "a"), (None, T + "a"), (8, "one two three four five six seven"), (8, "totally different text with other words in it"), (9, None), (10, ""), (None, None), (None, "alone in the dark without any id at all here"), (6, T.upper() + "a"), (12, "  ")]


def test_ngram_jaccard_null_and_repeated_ids(sp):
    got = ngram_jaccard.ngram_jaccard(sp.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, component long")).collect()
    root = groups([t for _, t in ROWS], 4, 85, 100)
    least = {}
    for (d, _), r in zip(ROWS, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted(((d, len(shingles(t, 4)), least.get(r)) for (d, t), r in zip(ROWS, root)), key=repr)
    assert sorted((tuple(x) for x in got), key=repr) == want


def test_near_duplicate_stage_keeps_one_row_of_each_group(sp):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = sp.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, component string")
    got = pipeline.near_duplicates(sp, docs, None)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(6, T.upper() + "a"), (8, ROWS[4][1]), (8, ROWS[5][1]), (9, None), (10, ""), (None, None), (None, ROWS[9][1]), (12, "  ")], key=repr)


def test_near_duplicate_stage_equals_brute_force(sp):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(400)
    got = {r.doc_id for r in pipeline.near_duplicates(sp, sp.createDataFrame(docs), SF).select("doc_id").collect()}
    root = groups(docs.text.tolist(), 5, 80, 100)
    ids = docs.doc_id.tolist()
    least = {}
    for d, r in zip(ids, root):
        least[r] = min(least.get(r, d), d)
    assert got == set(least.values()) and len(got) < len(ids)


def test_line_stage_equals_sql(sp):
    """The stage's texts are the DuckDB twin's; texts of which nothing is left go."""
    pipeline = pytest.importorskip("corpus_pipeline")
    documents = pd.read_parquet(f"{SF}/documents.parquet").head(500)
    got = {r.doc_id: r.text for r in pipeline.lines(sp, sp.createDataFrame(documents), SF).collect()}
    gone = duckdb.connect()
    gone.register("documents", documents)
    removed = {r.doc_id: set(map(int, r.removed.split(","))) if r.removed else set() for r in gone.sql(line_dedup.oracle()).df().itertuples()}
    want = {}
    for d, t in zip(documents.doc_id, documents.text):
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[d])
        if left.strip() or not removed[d]:
            want[d] = left
    assert got == want and any(removed.values())


def test_line_dedup_twin_knows_white_space_and_runs(sp):
    """CRLF and tabs, a run whose gram first stands in other company: operator and twin agree line by line."""
    def words(tag, n):
        return " ".join(f"{tag}{j}" for j in range(n))

    grams = [words(f"g{i}x", 20) for i in range(3)]
    texts = ["\n".join([words(f"o{i}a", 45), g, words(f"o{i}b", 45)]) for i, g in enumerate(grams)]
    run = "\n".join(grams)
    texts += [words("p", 30) + "\n" + run + "\n" + words("q", 30), words("r", 30) + "\n" + run + "\n" + words("s", 30)]
    tabbed = ["\t".join(f"r{i}v{j}" for j in range(15)) for i in range(4)]
    texts += ["\n".join(tabbed), "\r\n".join(tabbed) + "\r\nend", "\n".join("\t" + x + " \t" for x in tabbed), "\x0b\n\x0c", ""]
    rng = np.random.RandomState(3)
    pool = [words(f"w{k}v", n) for k, n in enumerate(rng.choice([1, 2, 5, 19, 20, 26, 49], 9))]
    texts += ["\n".join(pool[k] for k in rng.randint(0, len(pool), 14)) for _ in range(30)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = {r.doc_id: ",".join(map(str, r.lines_removed)) for r in line_dedup.dedup_lines(sp.createDataFrame(documents)).collect()}
    db = duckdb.connect()
    db.register("documents", documents)
    want = {r.doc_id: r.removed for r in db.sql(line_dedup.oracle()).df().itertuples()}
    assert got == want and got[4] == "1,2,3" and got[6] == got[7] == "0,1,2,3"


def test_line_dedup_reserves_no_names(sp):
    run = "\n".join(" ".join(f"r{i}_{j}" for j in range(15)) for i in range(4))
    df = sp.createDataFrame([(1, run, 1, 2, "a", [5]), (2, run + "\nother", 3, 4, "b", None), (None, run, 5, 6, "c", None), (2, run + "\nother", 3, 4, "b", None)],
                            "doc_id long, text string, __id int, __ver int, __gone string, lines_removed array<int>")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r["__id"], r["__ver"], r["__gone"], r.lines_removed) for r in out.collect()), key=repr)
    assert got == sorted([(1, run, 1, 2, "a", []), (2, "other", 3, 4, "b", [0, 1, 2, 3]), (None, run, 5, 6, "c", []), (2, "other", 3, 4, "b", [0, 1, 2, 3])], key=repr)


def test_pipeline_on_odd_rows_and_empty_tables(sp):
    """All stages in a row: nulls, repeated rows, clashing names, a very long text; then no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = sp.read.parquet(f"{SF}/documents.parquet").limit(150)
    long_ = "the quick brown fox jumps over " * 20_000
    odd = [(None, None, None, None, None), (90_001, "", "en", "a", 0), (90_002, long_, "en", "a", len(long_)), (90_002, long_, "en", "a", len(long_)), (None, long_, "en", None, None), (90_003, "....", None, "b", 4), (90_004, "the cat sat on the mat", "en", "b", 22)]
    docs = base.unionByName(sp.createDataFrame(odd, base.schema))
    docs = docs.withColumn("__id", F.lit(1)).withColumn("gone", F.lit("x")).withColumn("component_id", F.lit(2))
    for frame in (docs, docs.where("false")):
        kept = frame
        for name, stage in pipeline.STAGES[:-1]:
            before = kept.count()
            kept = sp.createDataFrame(stage(sp, kept, SF).toArrow(), frame.schema) if before else stage(sp, kept, SF)
            assert kept.columns == frame.columns and kept.count() <= before, name
        packed = pipeline.STAGES[-1][1](sp, kept, SF).toPandas()
        assert set(packed.doc_id) == {r.doc_id for r in kept.select("doc_id").collect()}
        ids = kept.select("doc_id").collect()
        assert sum(r.doc_id in (90_002, None) for r in ids) <= 1 and not any(r.doc_id in (90_001, 90_003) for r in ids)
