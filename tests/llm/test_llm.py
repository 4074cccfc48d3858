"""Operators of netlake.llm on small fixtures: brute force, round trips, held-out accuracy, odd rows."""
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlake.llm import decontaminate, language_crf, line_dedup, ngram_jaccard, packing, quality_eb, queries, secret_scan, spotsigs, textops, toxicity, training_order
from netlake.llm.tokens import public_bpe, tokeniser
from netlake.session import ship_package

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, sig long"


@pytest.fixture(scope="session")
def sp(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def odd(sp):
    """Nulls, empty, blank, very long, repeated rows, clashing column names."""
    long_ = "the quick brown fox jumps over " * 20_000
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, None, None), (3, " \n\t ", "en", None, 4, None, None), (4, long_, "en", "a", len(long_), None, 2),
            (5, "the cat", "en", "a", 7, None, 3), (5, "the cat", "en", "a", 7, None, 3), (6, "....", None, "b", 4, None, None), (7, "été où ça", "fr", "b", 9, None, None), (8, long_ + "end", "en", "a", len(long_) + 3, None, None)]
    return sp.createDataFrame(rows, SCHEMA)


def test_word_hashes_follow_the_word_rule():
    texts = ["Ab c\x0bd", None, "", "  x  ", "É é ab"]
    data, off = textops.buffers(pa.array(texts))
    h, _, _, ptr = textops.words(data, off)
    got = [h[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])]
    assert [len(x) for x in got] == [3, 0, 0, 1, 3]
    assert got[0][0] == got[4][2] and got[4][0] != got[4][1]


def _sets(texts, width):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        yield frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _components(ids, sets, num, den):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sorted(zip(ids, sets), key=lambda x: x[0]):
        common = {}
        for g in s:
            for j, n in where.get(g, ()):
                common[j, n] = common.get((j, n), 0) + 1
            where.setdefault(g, []).append((i, len(s)))
        for (j, n), c in common.items():
            if den * c >= num * (len(s) + n - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_ngram_jaccard_equals_brute_force(sp, docs):
    got = ngram_jaccard.ngram_jaccard(sp.read.parquet(f"{SF}/documents.parquet")).toPandas().set_index("doc_id")
    sets = list(_sets(docs.text, 4))
    want = _components(docs.doc_id.tolist(), sets, 85, 100)
    assert got.component_id.to_dict() == want
    assert got.n_shingles.to_dict() == dict(zip(docs.doc_id, map(len, sets)))


def test_ngram_jaccard_chains_and_strangers(sp):
    """Drifting copies (neighbours similar, ends not), and texts that share a passage only."""
    rng = np.random.RandomState(3)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words = list(words)
        words[rng.randint(120)] = f"n{k}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + k, passage + " " + " ".join(f"t{k}_{i}" for i in range(rng.randint(3, 40)))) for k in range(80)]
    rng.shuffle(rows)
    df = sp.createDataFrame([(int(a), str(b)) for a, b in rows], "doc_id long, text string")
    got = ngram_jaccard.ngram_jaccard(df.repartition(3)).toPandas().set_index("doc_id").component_id.to_dict()
    assert got == _components([int(r[0]) for r in rows], list(_sets([r[1] for r in rows], 4)), 85, 100)


def test_partenum_signatures_cover_similar_sets():
    rng = np.random.RandomState(5)
    for size in (6, 7, 9, 14, 30, 60, 200):
        for _ in range(20):
            a = np.unique(rng.randint(0, 1 << 62, size).astype(np.uint64))
            drop = rng.randint(0, len(a))
            b = a
            while True:
                c = np.delete(b, rng.randint(len(b)))
                if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                    break
                b = c
            assert len(np.intersect1d(ngram_jaccard.signatures(a, 85, 100), ngram_jaccard.signatures(np.sort(b), 85, 100))), (size, drop)


def test_line_dedup_equals_sql(sp, docs):
    got = queries.QUERIES["op9_line_dedup"](sp, SF).toPandas().set_index("doc_id").sort_index()
    db = duckdb.connect()
    db.register("documents", docs)
    want = db.sql(line_dedup.oracle()).df().set_index("doc_id").sort_index()
    assert (got.n_removed > 0).any()
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def test_line_dedup_first_copy_stays(sp):
    run = "\n".join(" ".join(f"r{i}_{j}" for j in range(15)) for i in range(4))
    df = sp.createDataFrame([(1, "own line one\n" + run), (2, run + "\nother"), (3, None), (4, "short\nshort")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "own line one\n" + run, 2: "other", 3: None, 4: "short\nshort"}


def test_line_dedup_knows_all_white_space(sp):
    lines = ["\t".join(f"r{i}v{j}" for j in range(15)) for i in range(4)]
    texts = ["\n".join(lines), "\r\n".join(lines) + "\r\nend", "\n".join("\t" + x + " \t" for x in lines)]
    got = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(sp.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3]}


def _seen_before(texts, run_words):
    """Lines of each text in any run of at least ``run_words`` words that occurred at an earlier place, by all runs."""
    first, gone = {}, []
    for d, t in enumerate(texts):
        kept = [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        size, out = [x.count(" ") + 1 for _, x in kept], set()
        for a in range(len(kept)):
            for b in range(a + 1, len(kept) + 1):
                if sum(size[a:b]) >= run_words and first.setdefault(tuple(x for _, x in kept[a:b]), (d, a)) != (d, a):
                    out |= {i for i, _ in kept[a:b]}
        gone.append(out)
    return gone


def test_line_dedup_run_with_an_older_gram(sp):
    """Each line group of a run also stands in an older text of other company; the whole run occurs only later."""
    words = lambda tag, n: " ".join(f"{tag}{j}" for j in range(n))
    grams = [words(f"g{i}x", 20) for i in range(3)]
    texts = []
    for i, g in enumerate(grams):
        texts.append("\n".join([words(f"o{i}a", 45), g, words(f"o{i}b", 45)]))
    run = "\n".join(grams)
    texts += [words("p", 30) + "\n" + run + "\n" + words("q", 30), words("r", 30) + "\n" + run + "\n" + words("s", 30)]
    rng = np.random.RandomState(3)
    pool = [words(f"w{k}v", n) for k, n in enumerate(rng.choice([1, 2, 5, 19, 20, 26, 49], 9))]
    texts += ["\n".join(pool[k] for k in rng.randint(0, len(pool), 14)) for _ in range(40)]
    got = {r.doc_id: set(r.lines_removed) for r in line_dedup.dedup_lines(sp.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = _seen_before(texts, line_dedup.RUN_WORDS)
    assert got[4] == want[4] == {1, 2, 3}
    assert all(want[d] <= got[d] for d in got)
    lines, seen = [t.split("\n") for t in texts], set()
    for d, t in enumerate(lines):
        for i, x in enumerate(t):
            assert x in seen or i not in got[d]
            seen.add(x)


def test_decontamination_finds_edited_passages(sp, docs):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    rng = np.random.RandomState(9)
    rows, want = [], set()
    for k in range(60):
        i = rng.randint(len(bench))
        t = list(bench.text[i])
        for _ in range(len(t) // 25):
            p = rng.randint(len(t))
            t[p : p + 1] = ["", "zq", "x"][rng.randint(3)]
        rows.append((k, docs.text[k % 5][:200] + "\n" + "".join(t).upper().replace("SS", "ß")))
        want.add((k, int(bench.item_id[i])))
    rows += [(1000 + k, " ".join(f"{chr(97 + k % 26)}lean{j}" for j in range(50))) for k in range(30)]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, sp.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert want <= got and not any(d >= 1000 for d, _ in got)
    exact = {(int(d), int(i)) for d, t in zip(docs.doc_id, docs.text) for i, b in zip(bench.item_id, bench.text) if b in t}
    whole = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_decontaminate"](sp, SF).collect()}
    assert exact and exact <= whole
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(sp.read.parquet(f"{SF}/documents.parquet"), sp.read.parquet(f"{SF}/benchmark.parquet"), block_chars=2000).collect()}
    assert blocks == whole
    assert decontaminate.clean(sp.read.parquet(f"{SF}/documents.parquet"), sp.read.parquet(f"{SF}/benchmark.parquet")).count() == len(docs) - len({d for d, _ in whole})


def test_decontamination_finds_passages_from_any_place(sp):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    rng = np.random.RandomState(11)
    norms = {int(i): decontaminate.normalise(*textops.buffers(pa.array([t])))[0].tobytes().strip() for i, t in zip(bench.item_id, bench.text)}
    rows, want = [], set()
    for item, t in norms.items():
        if len(t) >= 180:
            s, edit = rng.randint(1, len(t) - decontaminate.WINDOW), rng.randint(10, 86, 3)
            passage = t[s : s + decontaminate.WINDOW]
            edited = bytearray(passage)
            for p in edit:
                edited[p] = ord("#")
            for k, (head, p) in enumerate([(b"qzx " * 20, passage), (b"", passage), (b"qzx " * 20, bytes(edited).replace(b"#", b"q"))]):
                rows.append((10 * item + k, (head + p + b" vwk" * 20).decode("utf-8", "ignore")))
                want.add((10 * item + k, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(sp.createDataFrame(rows, "doc_id long, text string"), sp.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(want) > 30 and want <= got
    low = decontaminate.Index([(1, "abcdefghijklmnopqrstuvwxyz0123456789")], decontaminate.Q, decontaminate.WINDOW, decontaminate.ERROR)
    cut, ptr, _ = decontaminate.normalise(*textops.buffers(pa.array(["bcdefghijklmnopqrstuvwxyz0123456789"])))
    assert [h[:3] for h in decontaminate.verified(cut, ptr, low)][:1] == [(0, 1, 1)]


def test_secret_spans_equal_python(sp, docs):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    extra = ["secret: token: abcdefgh", "é\U0001f600 TOKEN='abc.def' ApiKey = abcdef", "AKIAAKIA" + "A" * 14 + " " + "a" * 30, None, ""]
    rows = [*zip(docs.doc_id.tolist(), docs.text), *enumerate(extra, 10**6)]
    paths, findings, _ = secret_scan.scan(sp.createDataFrame([(int(a), b) for a, b in rows], "doc_id long, text string"))
    got = {r.path: r.spans for r in secret_scan.path_digest(paths, findings).collect()}
    for i, t in rows:
        found = sorted((m.start(), k, n, m.end()) for k, (n, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= least)
        assert got[i] == ",".join(f"{n}:{a}:{b}" for a, _, n, b in found), i


def test_secret_ledger_scans_only_unseen(sp):
    one = sp.createDataFrame([(1, "token = abcdef1"), (2, "token = abcdef1"), (3, "nothing")], "doc_id long, text string")
    _, findings, seen = secret_scan.scan(one)
    assert findings.count() == 1 and seen.count() == 2 * len(secret_scan.RULES)
    two = one.union(sp.createDataFrame([(4, "token = abcdef2")], "doc_id long, text string"))
    paths, new, more = secret_scan.scan(two, seen)
    assert [r.start for r in new.collect()] == [0] and more.count() == len(secret_scan.RULES)
    assert secret_scan.path_digest(paths, findings.union(new)).where("n_assign = 1").count() == 3
    newer = {**secret_scan.RULES, "hex": (*secret_scan.RULES["hex"][:4], 2)}
    assert {(r.rule, r.version) for r in secret_scan.scan(one, seen, newer)[2].collect()} == {("hex", 2)}


def test_best_fit_plan_equals_plain_best_fit():
    rng = np.random.RandomState(1)
    for _ in range(20):
        lengths = rng.randint(1, 65, rng.randint(1, 200)).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        ranges, windows = packing.best_fit_plan(counts, 64)
        room = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in room if r >= n]
            room.append(64) if not fit else None
            r = min(fit) if fit else 64
            room[room.index(r)] -= n
        assert windows == len(room)
        used = np.zeros((windows, 64), int)
        for (n, rank, win, at), nxt in zip(ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].tolist(), [*ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].tolist()[1:], None]):
            upto = nxt[1] if nxt and nxt[0] == n else counts[n]
            used[win : win + upto - rank, at : at + n] += 1
        assert used.max() == 1 and used.sum() == sum(lengths)


def test_packing_round_trip(sp, docs):
    got = queries.QUERIES["op5_packing"](sp, SF).toPandas().sort_values(["sequence_id", "offset"])
    run = got.groupby("sequence_id").length.cumsum() - got.length
    assert (run == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    files = public_bpe()
    slow = tokeniser(files[0])
    text = dict(zip(docs.doc_id, docs.text))
    for d, g in list(got.groupby("doc_id"))[:80]:
        ids = np.append(slow.ids(text[d]), 0).astype("<u4")
        assert g.doc_tokens.iloc[0] == len(ids) == g.length.sum()
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    special = "a <|endoftext|> b"
    assert (tokeniser(*files).ids(special) == slow.ids(special)).all()


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 100, 1025):
        p = training_order.feistel(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n)) and (training_order.feistel(p, n, 5, back=True) == np.arange(n)).all()


def test_training_shards_round_trip(sp, docs, tmp_path):
    rec = training_order.training_records(sp.read.parquet(f"{SF}/documents.parquet"), public_bpe(), length=512, shard=100)
    rows = {r.slot: r for r in rec.collect()}
    assert sorted(rows) == list(range(len(rows)))
    training_order.write_shards(rec, str(tmp_path / "shards"))
    some = training_order.read_slots(sp, str(tmp_path / "shards"), 95, 20, 512, 100).collect()
    assert {r.slot: bytes(r.ids) for r in some} == {s: bytes(rows[s].record[:-1]) for s in range(95, 115)}
    by_seq = {r.sequence_id: np.frombuffer(bytes(r.record[:-1]), "<u2")[: r.n_tokens] for r in rows.values()}
    tok = tokeniser(*public_bpe())
    whole = np.concatenate([by_seq[i] for i in range(len(by_seq))])
    assert len(whole) == sum(len(tok.ids(t)) + 1 for t in docs.text)


def test_spotsigs_edits(sp, docs):
    got = queries.QUERIES["op2_spotsigs"](sp, SF).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    import hashlib
    for k in range(len(order)):
        t, n = order.text[k], order.text[(k + 1) % len(order)]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got.loc[order.doc_id[k]]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_next == pytest.approx(spotsigs.likeness(spotsigs.spots_of(r.fingerprint), spotsigs.spots_of(got.loc[order.doc_id[(k + 1) % len(order)]].fingerprint)))
    assert got.groupby(docs.set_index("doc_id").text).fingerprint.nunique().max() == 1
    assert got.near_edited.mean() > 0.2 > got.near_next.mean()


def test_spotsigs_join_equals_brute_force(sp, docs):
    pairs, classes = spotsigs.similar_documents(sp.read.parquet(f"{SF}/documents.parquet"), 0.8)
    got = {(r.a, r.b) for r in pairs.collect()}
    data, off = textops.buffers(pa.array(docs.text))
    first = {}
    for d, s in sorted(zip(docs.doc_id.tolist(), spotsigs.spot_sets(data, off)), key=lambda x: x[0]):
        first.setdefault(s.tobytes(), (d, s))
    reps = [x for x in first.values() if len(x[1])]
    want = {(a, b) for i, (a, s) in enumerate(reps) for b, t in reps[i + 1 :] if spotsigs.likeness(s, t, 0.8) >= 0.8}
    assert got == {(min(p), max(p)) for p in want}
    sets = {d: s.tobytes() for d, s in zip(docs.doc_id.tolist(), spotsigs.spot_sets(data, off))}
    assert {r.doc_id: r.class_id for r in classes.collect()} == {d: first[s][0] if s else d for d, s in sets.items()}


def test_spotsigs_classes_lose_no_copy(sp):
    text = "the river runs on to the sea and the old mill stands by the water of this valley"
    rows = [(5, text), (3, text), (3, text), (None, text), (8, text + " in green fields"), (9, None), (1, ""), (None, "a lone row of the sheep in a field"), (7, "zz")]
    pairs, classes = spotsigs.similar_documents(sp.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, mark int"), 0.5)
    assert sorted(((r.doc_id, r.class_id) for r in classes.collect()), key=repr) == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (8, 8), (9, 9), (1, 1), (None, None), (7, 7)], key=repr)
    assert {(r.a, r.b) for r in pairs.collect()} == {(3, 8)}


def _plain_spots(text):
    """Spots as tuples of words: an anchor and the next two content words."""
    words = re.findall("[a-z\x80-\U0010ffff]+", text.translate({65 + i: 97 + i for i in range(26)}))
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        behind = [words[j] for j in content if j > i][: spotsigs.CHAIN]
        if w in spotsigs.ANCHORS and len(behind) == spotsigs.CHAIN:
            out.add((w, *behind))
    return out


def test_spots_and_likeness_equal_plain_words(sp, docs):
    some = docs[docs.text.str.len() < 6000].head(120)
    got = spotsigs.fingerprints_with_edits(sp.createDataFrame(some[["doc_id", "text"]])).toPandas().set_index("doc_id")
    order = some.sort_values("doc_id", ascending=False).reset_index(drop=True)
    close = 0
    for k in range(len(order)):
        t, n = order.text[k], order.text[(k + 1) % len(order)]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (_plain_spots(x) for x in (t, e, n))
        r = got.loc[order.doc_id[k]]
        if not (a and b and c):
            continue
        assert int(r.fingerprint.partition(":")[0]) == len(a)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        close += 1
    assert close > 80


def test_quality_posteriors_equal_a_loop_over_sites(sp, docs):
    """Host and path means and scores recomputed from the evidence, site by site, the document itself left out."""
    got = queries.QUERIES["op6_quality_eb"](sp, SF).toPandas().merge(docs[["doc_id", "source", "lang"]], on="doc_id")
    sites, hosts = {}, {}
    for e, h, p in zip(got.evidence, got.source, got.lang):
        sites.setdefault((h, p), []).append(e)
        hosts.setdefault(h, []).append(e)
    prior = min(max(got.evidence.mean(), 1e-4), 1 - 1e-4)

    def pseudo(groups):
        n, m, up = np.array([len(x) for x, _ in groups]), np.array([np.mean(x) for x, _ in groups]), np.array([u for _, u in groups])
        room = prior * (1 - prior)
        spread = ((n * (m - up) ** 2).sum() - (len(n) - 1) * room) / max(n.sum() - (n ** 2).sum() / n.sum(), 1e-9)
        return min(max(room / max(spread, 1e-9) - 1, 2.0), 1000.0)

    hw = pseudo([(x, prior) for x in hosts.values()])
    pw = pseudo([(x, np.mean(hosts[h])) for (h, _), x in sites.items()])
    for r in got.itertuples():
        s, h = sites[r.source, r.lang], hosts[r.source]
        host_mean = (sum(h) - r.evidence + hw * prior) / (len(h) - 1 + hw)
        path_mean = (sum(s) - r.evidence + pw * host_mean) / (len(s) - 1 + pw)
        odds = lambda x: np.log(x / (1 - x))
        score = 1 / (1 + np.exp(-(odds(r.evidence) + odds(min(max(path_mean, 1e-4), 0.9999)) - odds(prior))))
        assert np.allclose([r.host_mean, r.path_mean, r.score], [host_mean, path_mean, score], atol=1e-9) and r.keep == (r.score >= 0.5)


def test_training_records_hold_every_id_in_order(sp, docs):
    """The records in sequence order are the documents' ids one after the other, each document whole and once."""
    some = docs.head(200)
    text = dict(zip(some.doc_id, some.text))
    rec = training_order.training_records(sp.createDataFrame(some[["doc_id", "text"]]).repartition(3), public_bpe(), length=512, shard=7).toPandas().sort_values("sequence_id")
    stream = np.concatenate([np.frombuffer(bytes(r.record[:-1]), "<u2")[: r.n_tokens] for r in rec.itertuples()])
    order = []
    for r in rec.itertuples():
        order += [d for d in r.doc_ids if not order or d != order[-1]]
    tok = tokeniser(*public_bpe())
    assert sorted(order) == sorted(text)
    assert (stream == np.concatenate([np.append(tok.ids(text[d]), 0) for d in order])).all()
    assert (rec.n_tokens.iloc[:-1] == 512).all() and sorted(rec.slot) == list(range(len(rec)))


def test_language_held_out_accuracy(sp, docs):
    got = queries.QUERIES["op10_language_crf"](sp, SF).toPandas().merge(docs, on="doc_id")
    got = got[got.held_out]
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_posteriors_equal_enumeration():
    rng = np.random.RandomState(2)
    em, trans, start = rng.randn(5, 3), rng.randn(3, 3), rng.randn(3)
    total = np.zeros((5, 3))
    for path in np.ndindex(*[3] * 5):
        total[range(5), path] += np.exp(start[path[0]] + sum(em[i, p] for i, p in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
    assert np.allclose(language_crf.posteriors(em, np.array([0, 5]), trans, start)[0], total / total.sum(1, keepdims=True))
    long_ = rng.randn(1000, 3)
    whole = language_crf.posteriors(long_, np.array([0, 1000]), trans, start)[0]
    keep, language_crf.PIECE = language_crf.PIECE, 2000
    try:
        assert np.allclose(whole, language_crf.posteriors(long_, np.array([0, 1000]), trans, start)[0])
    finally:
        language_crf.PIECE = keep


def test_toxicity_finds_gapped_insults():
    rng = np.random.RandomState(4)
    clean = ["the", "house", "river", "walking", "table", "morning", "green", "tired", "story", "loose"] + [a + b for a in ("ran", "tel", "mor", "sil") for b in ("ding", "low", "ten", "ker")]
    bad = ["idiot", "stupid", "pathetic"]
    texts, y = [], []
    for k in range(400):
        t = [clean[i] for i in rng.randint(0, 26, 30)]
        if k % 4 == 0:
            t.insert(rng.randint(30), bad[k // 4 % 3])
        texts.append(" ".join(t))
        y.append(k % 4 == 0)
    m = toxicity.train(texts, np.array(y), 0.25)
    score = lambda t: (lambda b: m.scores(b[0][: b[1][-1]], b[1])[0])(textops.buffers(pa.array([t])))
    assert score("the green house idiot by river") > 0.5 and score("the i d i o t walking") > 0.5 and score("so stuupid table") > 0.5 and score("p.a.t.h.e.t.i.c story") > 0.5
    assert score("the house by the river") < 0.5 and score("") < 0.5


def test_quality_held_out(sp):
    got = queries.QUERIES["op6_quality_eb"](sp, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    got = got[got.held_out]
    assert (got.keep == got.quality).mean() > 0.9


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables(sp, empty):
    df = odd(sp).where("false") if empty else odd(sp)
    n = df.count()
    labels = sp.createDataFrame([(i, i % 2, i % 2) for i in (2, 3, 4, 5, 7)], "doc_id long, quality int, toxic int")
    bench = sp.read.parquet(f"{SF}/benchmark.parquet")
    assert ngram_jaccard.ngram_jaccard(df).count() == n
    assert spotsigs.fingerprints_with_edits(df).count() == n
    assert decontaminate.contaminated(df, bench).count() == 0 and decontaminate.contaminated(df, bench.where("false")).count() == 0
    paths, findings, _ = secret_scan.scan(df)
    assert secret_scan.path_digest(paths, findings).count() == n
    assert packing.pack(df, public_bpe()).agg(F.countDistinct("doc_id")).first()[0] == (0 if empty else 8)
    q = quality_eb.classify(df, labels)
    assert q.count() == n and q.where("score is null").count() == 0
    assert training_order.training_records(df, public_bpe()).count() >= (0 if empty else 1)
    assert toxicity.predict(df, toxicity.fit(df, labels)).where("score between 0 and 1").count() == n
    out = line_dedup.dedup_lines(df)
    assert out.count() == n and out.columns == [*df.columns, "lines_removed"]
    pred = {r.doc_id: r.lang_pred for r in language_crf.predict(df, language_crf.fit(df)).collect()}
    assert empty or (pred[1] == pred[2] == pred[3] == pred[6] == "und" and pred[5] != "und")


def test_pipeline_stages(sp, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = sp.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in pipeline.STAGES:
        kept = stage(sp, kept, SF)
        if name != "packed":
            assert kept.columns == columns
            kept = sp.createDataFrame(kept.toPandas(), kept.schema)
            assert 0 < kept.count() <= len(docs)
    assert kept.count() > 0
