"""SimHash near duplicates against all pairs of plainly computed fingerprints."""
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from netlake.llm import queries, simhash_ball
from netlake.session import ship_package

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sp(spark):
    ship_package(spark)
    return spark


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    up = {i: i for i in ids if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, f) in enumerate(zip(ids, fps)):
        for j, g in zip(ids[:k], fps[:k]):
            if (f ^ g).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def test_query_equals_brute_force(sp):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op11_simhash_ball"](sp, SF).toPandas().set_index("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert got.fingerprint.to_dict() == {i: f"{f:016x}" for i, f in zip(docs.doc_id, fps)}
    assert got.component_id.to_dict() == plain_components(docs.doc_id.tolist(), fps)


def test_masks_cover_the_ball_and_passes_are_even():
    assert len(np.unique(simhash_ball.MASKS)) == 2081 and int(np.bitwise_count(simhash_ball.MASKS).max()) == 2
    assert (simhash_ball.colours(simhash_ball.MASKS) == simhash_ball.MOVES).all()
    assert sorted(set(np.bincount(simhash_ball.MOVES).tolist())) == [233, 264]


@pytest.mark.parametrize("part", [1 << 21, 1 << 10])
def test_links_reach_four_bits_and_no_more(sp, monkeypatch, part):
    """Values at every distance up to six from planted centres, chains among them, in one part and in many."""
    monkeypatch.setattr(simhash_ball, "PART", part)
    rng = np.random.RandomState(1)
    fps = []
    for _ in range(40):
        c = int(rng.randint(0, 1 << 62))
        for d in range(7):
            fps.append(c ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_ball.ball_links(sp.createDataFrame([(f,) for f in signed + signed[:9] + [None]], "fp long")).toPandas()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in zip(links.a.tolist(), links.b.tolist()))
    mask = (1 << 64) - 1
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(links.a.tolist(), links.b.tolist()):
        a, b = root(a & mask), root(b & mask)
        up[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == plain_components(fps, fps)


def test_odd_rows(sp):
    long_ = "The quick brown fox\tjumps  over\n" * 20_000
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t ", 3), (4, long_, 4), (5, "the cat", 5), (5, "THE  cat", 5), (None, "the cat", 6), (None, "zebra crossing near here", 7), (9, long_.lower(), 8), (10, "Été où", 9)]
    got = simhash_ball.simhash_near(sp.createDataFrame(rows, "doc_id long, text string, fp long")).toPandas()
    assert sorted(got.columns) == ["component_id", "doc_id", "fingerprint"] and len(got) == len(rows)
    want = {f"{plain_fingerprint(t):016x}" for _, t, _ in rows}
    assert set(got.fingerprint) == want and (got.fingerprint[got.doc_id.isin([1, 2, 3])] == "0" * 16).all()
    comp = {i: c for i, c in zip(got.doc_id, got.component_id) if i == i}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 9: 4, 10: 10}
    nulls = got[got.doc_id.isna()].set_index("fingerprint").component_id
    assert nulls[f"{plain_fingerprint('the cat'):016x}"] == 5 and pd.isna(nulls[f"{plain_fingerprint('zebra crossing near here'):016x}"])
    assert simhash_ball.simhash_near(sp.createDataFrame([], "doc_id long, text string")).count() == 0
