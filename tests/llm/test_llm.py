"""The corpus operators against brute force, and their defined results for nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import ann, bpe, exact_dedup, line_dedup, near_dedup, packing, quality, queries, suffix_dedup, toxicity, warc
from seriesmill.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, block int"
WORDS = [f"w{i}x" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, ids=None):
    """A documents table with extra columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "r", "d", 1) for i, t in zip(ids or range(len(texts)), texts)], DOC)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    base = prose(rng, 300)
    return [None, "", "   ", "a", base, base, base.replace("w1x", "q"), prose(rng, 6000), "é" * 450, base + "\n" + prose(rng, 50), "Ünïcode\x00 ‌test", "short text of five words"]


# ---------------------------------------------------------------- 1


def brute_suffix(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [100_000, 1])
def test_suffix_dedup_equals_brute_force(spark, odd, hot):
    rng = random.Random(hot)
    passages = [prose(rng, n) for n in (35, 41, 60, 200)]
    texts = [*odd, *[prose(rng, rng.randint(0, 40)) + rng.choice(passages)[rng.randint(0, 30) :] + prose(rng, rng.randint(0, 40)) for _ in range(60)], "ab" * 600, "ab" * 300]
    df = suffix_dedup.suffix_array_dedup(docs(spark, texts), hot=hot)
    got = {r["row"]["doc_id"]: tuple(r[1:5]) for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts)


def test_suffix_dedup_on_nothing_and_whole_characters(spark):
    assert suffix_dedup.suffix_array_dedup(docs(spark, ["x"]).limit(0)).count() == 0
    part = np.frombuffer("aéb".encode(), np.uint8)
    assert suffix_dedup.whole_characters(part, np.array([1, 1, 0, 0], bool)) == "éb"


def test_loser_tree_merges_runs_in_order_with_true_prefixes():
    rng = random.Random(1)
    every = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    runs = [suffix_dedup.Run(suffix_dedup.pack_run([(s, b"", 1) for s in sorted(every[k::7])]), k) for k in range(7)]
    last, out = b"", []
    for run, lcp in suffix_dedup.merge_runs(runs):
        assert lcp == suffix_dedup.common(last, run.suffix, 0)
        last = run.suffix
        out.append(last)
    assert out == sorted(every)


def test_the_merged_order_decides_what_is_repeated(monkeypatch):
    """Repeated windows come from common prefixes of neighbours: without them nothing is found."""
    rng = random.Random(2)
    gram = bytes(rng.choice(b"xyz") for _ in range(64))
    lefts, rights = [bytes(rng.choice(b"abc") for _ in range(136)) for _ in range(3)], [bytes(rng.choice(b"abc") for _ in range(136)) for _ in range(3)]
    items = [(gram + rng.choice(rights)[: rng.randint(60, 136)], rng.choice(lefts)[-rng.randint(60, 136) :]) for _ in range(60)]
    made = lambda: [suffix_dedup.Run(suffix_dedup.pack_run([(*x, 1) for x in sorted(set(items[k::5]))]), k) for k in range(5)]
    got = {(k, *row) for k, rows in suffix_dedup.repeated_windows(made(), 200).items() for row in rows.tolist()}
    want, runs = set(), [sorted(set(items[k::5])) for k in range(5)]
    seen = Counter((before + suffix)[i : i + 200] for run in runs for suffix, before in run for i in range(len(before + suffix) - 199))
    for k, run in enumerate(runs):
        for number, (suffix, before) in enumerate(run):
            text, starts = before + suffix, []
            for i in range(len(text) - 199):
                if seen[text[i : i + 200]] > 1:
                    starts.append(i)
            cut = [i for i in starts if i - 1 not in starts]
            want |= {(k, number, i, next(j for j in range(i, len(text)) if j + 1 not in starts) + 200) for i in cut}
    assert got == want and got
    merged = suffix_dedup.merge_runs
    monkeypatch.setattr(suffix_dedup, "merge_runs", lambda runs: ((r, 0) for r, _ in merged(runs)))
    assert not suffix_dedup.repeated_windows(made(), 200) or not any(len(x) for x in suffix_dedup.repeated_windows(made(), 200).values())


# ---------------------------------------------------------------- 2, 5


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, odd, library):
    texts = [*odd, "it's we'll 'sand ''s !'s 're've I'M o'clock 1234'll", "<|endoftext|> a <|startoftext|>b", "x" * 3000, "ΑΣ ΣΑΣ À é", "abcabc" * 500]
    got = {r["id"]: r for r in bpe.bpe_encode(docs(spark, texts), queries.vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(docs(spark, ["a b", None]), queries.vocabulary()), queries.vocabulary()).orderBy("id").collect()
    assert [r["text"] for r in back] == ["a</w> b</w>", ""]
    assert bpe.bpe_encode(docs(spark, ["x"]).limit(0), queries.vocabulary()).count() == 0


def check_pieces(rows, library, texts):
    by_doc, by_seq, pad = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r["id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad, len(by_seq)


def test_packing_places_every_id_once_without_padding(spark, odd, library):
    rng = random.Random(3)
    texts = dict(enumerate([*odd, *[prose(rng, rng.randint(0, 900)) for _ in range(40)]]))
    rows = packing.pack(docs(spark, list(texts.values())).repartition(3), queries.vocabulary()).collect()
    assert check_pieces(rows, library, texts)[0] == 0
    assert packing.pack(docs(spark, ["x"]).limit(0), queries.vocabulary()).count() == 0
    edge = packing.pack(docs(spark, ["x", "y", "z"], [None, -(2**63), 2**63 - 1]), queries.vocabulary()).collect()
    assert {r["id"] for r in edge} == {None, -(2**63), 2**63 - 1}


def served(batch):
    """Tokens of each source in each sequence."""
    used = defaultdict(Counter)
    for r in batch.to_pylist():
        used[r["sequence_id"]][r["source"]] += r["length"]
    return used


def fill(mixer, tokens):
    for s, n in tokens.items():
        docs = np.array([[k, 0, 77, 77, 0] for k in range(n // 77)], np.int64)
        mixer.add(np.full(len(docs), mixer.place[s]), docs, np.arange(77 * len(docs), dtype="<u4"))


def test_mixer_keeps_proportions_and_carries_deficits():
    shares = {"a": 0.7, "b": 0.2, "c": 0.0955, "d": 0.0045}
    m = packing.Mixer(shares, 1000, 16, 0)
    fill(m, {"a": 70_000, "b": 20_000, "c": 10_000, "d": 1_000})
    used, total = served(m.run(False)), Counter()
    assert len(used) > 90
    for k in sorted(used):
        assert sum(used[k].values()) == 1000
        total += used[k]
        assert all(abs(used[k][s] - 1000 * shares[s]) <= 18 for s in "abc") and used[k]["d"] in (0, *range(16, 22))
        assert all(abs(total[s] - shares[s] * 1000 * (k + 1)) <= 18 for s in shares)  # what a window lacks, the next ones make good
    assert abs(sum(m.deficit)) < 1e-6


def test_mixer_drains_dry_sources_last():
    m = packing.Mixer({"a": 0.5, "b": 0.25, "c": 0.25, "z": 0.0}, 1024, 16, 0)
    fill(m, {"a": 40_000, "b": 20_000, "c": 5_005, "z": 3_000})
    used = served(m.run(True))
    first = [used[k] for k in range(10)]
    assert all(abs(u["a"] - 512) <= 2 and abs(u["b"] - 256) <= 2 and abs(u["c"] - 256) <= 2 for u in first)
    later = [used[k] for k in range(25, 50)]  # without c the others have two thirds and one third
    assert all(abs(u["a"] - 683) <= 2 and abs(u["b"] - 341) <= 2 for u in later)
    assert sum(sum(u.values()) for u in used.values()) == sum(n // 77 * 77 for n in (40_000, 20_000, 5_005, 3_000))
    assert all((n := sum(u.values())) & (n - 1) == 0 for u in used.values()) and not m.held.any()


def test_packing_fills_the_windows_of_the_query_in_proportion(spark):
    """Every full window of the first pass has every source within two tokens of its share; those of the second pass while no source is dry."""
    at = "/root/testdata/sf0.01"
    docs_ = spark.read.parquet(f"{at}/documents.parquet").select("source", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    share = {r["source"]: r["n"] for r in docs_.groupBy("source").agg((F.sum("n") + F.count("n")).alias("n")).collect()}
    total = sum(share.values())
    rows = queries.op2_packing(spark, at).groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    used = defaultdict(Counter)
    for r in rows:
        used[r["sequence_id"]][r["source"]] += r["n"]
    assert all(sum(u.values()) in [1 << k for k in range(12)] for u in used.values())
    one = [u for k, u in used.items() if k < 1 << 62]
    two = [used[k] for k in sorted(used) if k >= 1 << 62]
    assert len(one) > 50 and all(abs(u[s] - 2048 * n / total) <= 2 for u in one for s, n in share.items())
    held = sum(two, Counter())
    for u in two:
        live = sum(share[s] for s in held if held[s])
        if all(held[s] > 2048 * share[s] / live + 200 for s in held if held[s]) and sum(u.values()) == 2048 and len(held) == len(share):
            assert all(abs(u[s] - 2048 * share[s] / total) <= 200 for s in share)  # the first windows also pay the deficits of all partitions
        held -= u


# ---------------------------------------------------------------- 3


def brute_near(texts, threshold=0.8):
    import regex

    sh = {}
    for i, t in texts.items():
        w = regex.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").lower())
        sh[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df, n = Counter(k for c in sh.values() for k in c), len(texts)
    w = {i: {k: (1 + math.log(v)) * (1 + 0.1 * math.log(n / df[k]) / math.log(n)) for k, v in c.items()} for i, c in sh.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and w[a] and w[b]:
                both = sum(min(w[a][k], w[b][k]) for k in w[a].keys() & w[b].keys())
                if both / (sum(w[a].values()) + sum(w[b].values()) - both) >= threshold:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = random.Random(9)
    texts = dict(enumerate(odd))
    for _ in range(4):
        base = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(120)] = rng.choice(WORDS)
            texts[len(texts)] = " ".join(copy)
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, list(texts.values())), piece=8).collect()}
    assert got == brute_near(texts)


def test_near_duplicates_of_the_given_documents_lose_no_link(spark):
    at = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_near_dedup(spark, at).collect()}
    want = brute_near(texts)
    assert got == want and len(set(want.values())) < len(want)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    rows = near_dedup.near_duplicates(docs(spark, ["a b c d e f"] * 3, [5, None, 5])).collect()
    assert sorted((r["id"] is None, r["class_id"], r["kept"]) for r in rows if r["id"]) == [(False, 5, True)] * 2
    assert [r["kept"] for r in rows if r["id"] is None] == [True]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == got[101] == got[100] == 100
    assert components(links.limit(0)).count() == 0


# ---------------------------------------------------------------- 4


def test_exact_dedup(spark):
    texts = ["a  b", "a\tb", "a b", None, "", " ", "A b", "a b"]
    got = {r["row"]["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    assert got == {0: (0, 3, True), 1: (0, 3, False), 2: (2, 1, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), 6: (6, 1, True), 7: (0, 3, False)}
    assert exact_dedup.keep_rows(docs(spark, ["x", "x", "y"], [1, 1, None])).count() == 2
    assert exact_dedup.exact_dedup(docs(spark, ["x"]).limit(0)).count() == 0


def test_cuckoo_index_inserts_deletes_and_grows():
    index, keys = exact_dedup.CuckooIndex(4), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.set(k, i)
    assert index.resizes > 0 and index.size == 3000 and all(index.get(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) for k in keys[:4]] == [None, 1, None, 3] and len(list(index.items())) == 1500


def test_index_changes(spark):
    k = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    t = lambda rows: spark.createDataFrame([(x,) for x in rows], "digest binary")
    index = spark.createDataFrame([(k[0], 2)], "digest binary, live long")
    out = exact_dedup.apply_changes(index, t([k[1], k[1], None]), t([k[0], k[0], k[0], k[2]]))
    assert [(bytes(r[0]), r[1]) for r in out.collect()] == [(k[1], 2)]


# ---------------------------------------------------------------- 6, 10


def test_label_model_separates_kinds_of_junk_without_labels():
    rng = np.random.default_rng(0)
    n, kind = 6000, rng.integers(-20, 4, 6000)  # most documents are good; four kinds of junk, each seen by one labeller
    miss, alarm = [0.1, 0.2, 0.05, 0.3], [0.002, 0.001, 0.004, 0.003]
    v = np.stack([np.where(kind == k, np.where(rng.random(n) < miss[k], 1, -1), np.where(rng.random(n) < alarm[k], -1, 1)) for k in range(4)], 1)
    patterns, count = np.unique(quality.pattern_of(v), return_counts=True)
    m = quality.LabelModel(4).fit(quality.votes_of(patterns, 4), count)
    true = np.array([((v[:, k] == 1) == (kind < 0)).mean() for k in range(4)])
    assert np.abs(m.accuracy() - true).max() < 0.05
    seen = (v == -1).any(1)
    assert (m.posterior(v)[seen & (kind >= 0)] < 0.5).mean() > 0.99 and (m.posterior(v)[~seen] > 0.5).all()


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(2)
    letters = str.maketrans("0123456789", "aeioulnrst")
    good = [". ".join(prose(rng, 12).translate(letters).capitalize() for _ in range(12)) for _ in range(60)]
    junk = ["BUY!!! NOW$$$ " * 40, "### *** @@@ " * 30, "ha ha ha ha " * 50] * 6
    got = quality.quality(docs(spark, [*good, *junk, None, ""])).select("row.doc_id", "score", "kept").orderBy("doc_id").collect()
    assert sum(r["kept"] for r in got[:60]) == 60
    assert sum(r["kept"] for r in got[60:78]) == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    twice = quality.quality(docs(spark, [good[0], good[0], junk[0], junk[0]], [1, 1, None, None])).select("row.doc_id", "score").collect()
    assert len(twice) == 4 and len({(r["doc_id"], r["score"]) for r in twice}) == 2  # rows that repeat get the same score
    assert quality.quality(docs(spark, ["x"]).limit(0)).count() == 0


def test_quality_agrees_with_labels_it_never_sees(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(truth[r["doc_id"]], r["kept"]) for r in queries.op6_quality(spark, at).collect() if r["doc_id"] in truth]
    good, bad = [k for q, k in got if q == 1], [k for q, k in got if q == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.05


def test_toxicity_of_the_query_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(truth[r["doc_id"]], r["predicted"]) for r in queries.op10_toxicity(spark, at).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for t, p in got if t == 1]) >= 0.8 and np.mean([p for t, p in got if t == 0]) <= 0.005


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    fm = toxicity.FactorizationMachine(np.arange(1, 7, dtype=np.uint64))
    row, place = np.nonzero(x)
    fm.fit(row, place, y)
    again = toxicity.FactorizationMachine.load(fm.save())
    assert (((again.margin(row, place, 3000) > 0) == (y > 0)).mean()) > 0.99
    alone = again.margin(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 3)
    assert alone[0] < 0 and alone[1] < 0 < alone[2]


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    rows = [(prose(rng, rng.randint(5, 80)) + (" you vile scumbag " if i % 4 == 0 else " ") + prose(rng, 20), int(i % 4 == 0)) for i in range(400)]
    d = docs(spark, [t for t, _ in rows] + [None, ""])
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    m = toxicity.train(d, labels, train_on=~toxicity.held_out("id"))
    got = toxicity.score(d, m, carry=["doc_id"]).select("row.doc_id", "score").collect()
    assert all((r["score"] >= 0.5) == bool(rows[r["doc_id"]][1]) for r in got if r["doc_id"] < 400)
    assert all(0 <= r["score"] < 0.5 for r in got if r["doc_id"] >= 400)
    none = toxicity.train(d, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(d, none, carry=["doc_id"]).collect())
    assert toxicity.score(d.limit(0), none).count() == 0


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    fm = toxicity.FactorizationMachine(np.arange(30, dtype=np.uint64), rank=3)
    fm.bias, fm.linear, fm.vectors = 0.3, rng.normal(size=30), rng.normal(size=(30, 3))
    sets = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 5, 30, 0)]
    row, place = np.repeat(np.arange(6), [len(x) for x in sets]), np.array([x for own in sets for x in own])
    want = [0.3 + sum(fm.linear[i] for i in x) + sum(fm.vectors[i] @ fm.vectors[j] for k, i in enumerate(x) for j in x[k + 1 :]) / math.sqrt(max(1, len(x))) for x in sets]
    assert np.allclose(fm.margin(row, place, 6), want)


def test_fit_follows_the_gradient_of_the_pairs():
    """A step on the vectors of one batch goes where the loss falls, as differences of the margin over all pairs say."""
    rng = np.random.default_rng(5)
    sets = [sorted(rng.choice(12, rng.integers(2, 6), replace=False).tolist()) for _ in range(64)]
    row, place = np.repeat(np.arange(64), [len(x) for x in sets]), np.array([x for own in sets for x in own])
    label = np.array([float(0 in x and 1 in x) for x in sets])
    fm = toxicity.FactorizationMachine(np.arange(12, dtype=np.uint64), rank=4)
    fm.fit(row, place, label, epochs=3, joint=60, visits=0)
    y = 2 * label - 1
    loss = lambda: np.logaddexp(0, -fm.margin(row, place, 64) * y).mean()
    with_pairs, kept = loss(), fm.vectors.copy()
    fm.vectors = np.zeros_like(kept)
    assert with_pairs < loss() and np.abs(kept).max() > 0.05


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_vectors_are_trained_and_take_part(spark, sf):
    at = f"/root/testdata/{sf}"
    d = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    m = toxicity.train(d, spark.read.parquet(f"{at}/labels.parquet"), train_on=~toxicity.held_out("id"))
    trained = np.abs(m.vectors).max(1) > 0
    assert 1000 < trained.sum() < m.size  # buckets that no two rows share have none
    scores = lambda: {r["doc_id"]: r["score"] for r in toxicity.score(d.where("doc_id < 300"), m, carry=["doc_id"]).select("row.doc_id", "score").collect()}
    one = scores()
    m.vectors = np.zeros_like(m.vectors)
    two = scores()
    open_ = [k for k in one if 1e-9 < one[k] < 1 - 1e-9]  # margins that end neither at 30 nor at -30
    assert len(open_) > 0.5 * len(one) and sum(abs(one[k] - two[k]) > 1e-12 for k in open_) > 0.9 * len(open_)


def test_toxicity_learns_a_pair_of_words_that_say_nothing_alone(spark):
    rng = random.Random(12)

    def made(n):
        """Both words in 4 % of the texts, which are toxic; each alone in 16 %, never toxic; the base rate is 20 %, as among the texts with a word."""
        kinds = [("alpha beta", 1)] * (n // 25) + [("alpha", 0), ("beta", 0)] * (4 * n // 25) + [("scumbag", 1)] * (4 * n // 25) + [("", 0)] * (12 * n // 25)
        return [(f"{a} {prose(rng, 6)}", y) for a, y in kinds]

    rows, fresh = made(2000), made(500)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    m = toxicity.train(docs(spark, [t for t, _ in rows]), labels)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs(spark, [t for t, _ in fresh]), m, carry=["doc_id"]).select("row.doc_id", "score").collect()}
    pair = [got[i] for i, (t, _) in enumerate(fresh) if t.startswith("alpha beta")]
    rest = [got[i] == bool(y) for i, (t, y) in enumerate(fresh) if not t.startswith("alpha beta")]
    assert sum(pair) >= 0.9 * len(pair) and sum(rest) >= 0.97 * len(rest)


# ---------------------------------------------------------------- 7


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 1200 + "</p>\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", "é" * 600), (7, "http://g", "é" * 600), (None, "http://n", big), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_captures(pages), path, captures_per_file=2)
    got = warc.captures_of(warc.read_archives(spark, path))
    assert got.count() == len(rows)
    by = {r["page_id"]: r for r in got.collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in by.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("revisit", 7), 7: ("response", None), None: ("revisit", 2)}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert (by[k]["payload_bytes"], by[k]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        if by[k]["record_type"] == "response":
            assert bytes(by[k]["reply"]["payload"]) == raw
    assert by[1]["request"]["http_head"].startswith("GET http://a/%20b%0D%0A")
    none = str(tmp_path / "none")
    (tmp_path / "none").mkdir()
    warc.write_archives(warc.plan_captures(pages.limit(0)), none)
    assert warc.captures_of(warc.read_archives(spark, none)).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh") for _ in range(n)), "x", "y", 3) for i, n in enumerate([10, 500, 2_000, 90_000, 90_001, 1_500_000, 2_000, 10])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string, id int")  # clashing names
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_captures(pages), path, file_bytes=100_000, captures_per_file=100)
    got = {r["page_id"]: r["payload_digest"] for r in warc.captures_of(warc.read_archives(spark, path)).collect()}
    assert got == {r[0]: hashlib.sha1(r[2].encode()).hexdigest() for r in rows}
    import gzip
    from pathlib import Path

    sizes = [len(gzip.decompress(f.read_bytes())) for f in Path(path).rglob("*.gz")]
    assert sum(n > 200_000 for n in sizes) == 1  # only the capture that is larger by itself


def test_warc_reads_what_a_cut_file_holds():
    import gzip
    import io as _io

    one = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3):
        assert [b for _, b in warc.parse_records(warc._opened(data))] == [b"abc"] * 3
    assert len(list(warc.parse_records(warc._opened((one * 3)[:-30])))) == 2
    assert len(list(warc.parse_records(warc._opened((gzip.compress(one) * 3)[:-20])))) >= 2
    assert list(warc.parse_records(_io.BytesIO(b"plain text"))) == []


# ---------------------------------------------------------------- 8


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(float)
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=400, block_rows=10).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)
        hits += len(set(best) & {m[1] for m in mine})
    assert hits >= 0.9 * 300
    clashing = df.withColumn("id", F.lit(1)).withColumn("v", F.lit("x")).withColumn("shard", F.lit(3)).withColumn("block", F.lit(9)).withColumn("score", F.lit(0))
    assert sorted(map(str, ann.nearest(clashing, clashing.where("vec_id % 50 = 0"), shard_rows=400, block_rows=10).collect())) == sorted(map(str, got))
    few = ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_neighbours_of_repeated_rows(spark):
    """Repeated queries are asked once, all rows but the query's own are candidates, and one id with two vectors has two answers."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[0], rows[7], (10, (x[10] + 0.01).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), k=10, threshold=0.01, reach=9.0).collect():  # all are verified
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = defaultdict(list)
    for q, v in {(i, tuple(v)) for i, v in rows if i % 10 == 0}:
        others = list(rows)
        others.remove((q, list(v)))
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in others)[:10]
        want[q] += [(k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert set(got) == set(want) and len(got[10]) == 20 and len(got[0]) == 10
    for q in want:
        assert [(a, b) for a, b, _ in sorted(got[q], key=lambda t: (t[0], t[2]))] == [(a, b) for a, b, _ in sorted(want[q], key=lambda t: (t[0], t[2]))]
        assert np.allclose(sorted(c for _, _, c in got[q]), sorted(c for _, _, c in want[q]))
    assert [i for _, i, d in sorted(got[0])][:2] == [0, 0] and all(d == 0 for _, i, d in sorted(got[0])[:2])


def test_nearest_neighbours_of_embeddings_verify_few_vectors(spark):
    """On the given embeddings: recall of the query, and how many vectors get past the collision threshold."""
    at = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [r for r in spark.read.parquet(at).select("vec_id", "embedding").orderBy("vec_id").collect() if r["embedding"] is not None]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    by = defaultdict(set)
    for r in queries.op8_ann(spark, "/root/testdata/sf0.1").collect():
        by[r["query_id"]].add(r["vec_id"])
    index = ann.CollisionIndex(x, 128, 11)
    hits, asked = 0, np.flatnonzero(ids % 100 == 0)
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & by[int(ids[q])])
        index.search(x[q], np.array([q]), ids, 10, 0.87, 1.6, 1.1)
    assert hits >= 0.9 * 10 * len(asked)
    assert index.verified < 0.1 * len(asked) * len(x)


# ---------------------------------------------------------------- 9


def test_patience_pairs_equal_lines_in_order():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randint(1, 12) for _ in range(rng.randint(0, 15))], [rng.randint(1, 12) for _ in range(rng.randint(0, 15))]
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_line_dedup_removes_shared_blocks_from_the_later_document(spark):
    rng = random.Random(6)
    block = [prose(rng, 9) for _ in range(4)]
    own = lambda: [prose(rng, 9) for _ in range(3)]
    texts = ["\n".join(own() + block + own()), "\n".join(own() + block + own()), "\n".join(own()), None, "", "\n".join(block)]
    for chunk in (4096, 2):
        got = {r["id"]: r for r in line_dedup.line_dedup(docs(spark, texts), chunk=chunk).collect()}
        assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 4 and got[5]["n_removed"] == 4 and got[2]["n_removed"] == 0
        assert got[1]["kept_text"] == "\n".join(texts[1].split("\n")[:3] + texts[1].split("\n")[-3:])
        assert (got[3]["n_lines"], got[3]["kept_text"]) == (1, "")
    assert line_dedup.line_dedup(docs(spark, ["x"]).limit(0)).count() == 0
    twice = line_dedup.line_dedup(docs(spark, ["\n".join(block)] * 2, [7, 7])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]


def brute_lines(texts, least_words=5):
    """How many lines go from each text when it is aligned with all earlier ones."""
    split = [t.split("\n") for t in texts]
    hashes, sizes = [[line_dedup.line_hash(x) for x in own] for own in split], [[len(x.split()) for x in own] for own in split]
    return [len({j for i in range(k) for j in line_dedup.common_blocks(hashes[i], hashes[k], sizes[k], least_words)}) for k in range(len(texts))]


def test_line_dedup_aligns_with_all_earlier_documents(spark, monkeypatch):
    rng = random.Random(9)
    x, y, z = (prose(rng, 9) for _ in range(3))
    texts = ["\n".join(t) for t in ([x, y, z], [z, y, x], [x, y, z, "own"])]
    got = {r["id"]: r["n_removed"] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert [got[k] for k in range(3)] == brute_lines(texts) == [0, 1, 3]
    lines = [prose(rng, 6) for _ in range(7)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.8 else prose(rng, 6) for _ in range(rng.randint(1, 7))) for _ in range(120)]  # permuted and doubled lines
    for chunk, edges in ((4096, 1024), (16, 1024), (8, 3)):
        monkeypatch.setattr(line_dedup, "EDGES", edges)
        got = {r["id"]: r["n_removed"] for r in line_dedup.line_dedup(docs(spark, texts), chunk=chunk).collect()}
        assert [got[k] for k in range(len(texts))] == brute_lines(texts)


@pytest.mark.parametrize("rare", [1, 8, 64])
def test_line_dedup_ends_for_any_number_of_rare_partners(spark, rare):
    """Frequent lines that no alignment deletes, as they stand in other orders or are too short alone."""
    rng = random.Random(rare)
    lines, short = [prose(rng, 6) for _ in range(5)], [prose(rng, 2) for _ in range(3)]
    texts = ["\n".join([rng.choice(lines), rng.choice(short), prose(rng, 7), rng.choice(lines), rng.choice(lines)]) for _ in range(90)]
    got = {r["id"]: r["n_removed"] for r in line_dedup.line_dedup(docs(spark, texts), rare=rare).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts)


def test_line_dedup_finds_blocks_of_short_lines(spark):
    rng = random.Random(10)
    verse = [prose(rng, 4) for _ in range(20)]
    texts = ["\n".join(["own " + prose(rng, 8)] + verse), "\n".join(verse[:10] + ["", prose(rng, 8)]), "\n".join([prose(rng, 8)] + verse[5:7] + [prose(rng, 8)] + verse[11:12])]
    got = {r["id"]: r["n_removed"] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert [got[k] for k in range(3)] == brute_lines(texts) == [0, 10, 2]
    lines = ["", *(prose(rng, n) for n in (1, 2, 3, 4, 6))]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.8 else prose(rng, 2) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    got = {r["id"]: r["n_removed"] for r in line_dedup.line_dedup(docs(spark, texts), chunk=32).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts)


# ---------------------------------------------------------------- the queries and the pipeline


def test_twins(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, small)
        c = con.execute(sql)
        names = [x[0] for x in c.description]
        assert sorted(map(str, c.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_pipeline_keeps_clean_documents_and_their_columns(spark, small):
    import corpus_pipeline as P
    from seriesmill.llm.common import stored

    d = spark.read.parquet(f"{small}/documents.parquet")
    before = d.count()
    for name, stage in P.STAGES[:-1]:
        after = stored(stage(spark, d, small))
        assert after.columns == d.columns and 0 < after.count() <= d.count(), name
        assert after.join(d, "doc_id", "left_anti").count() == 0
        d = after
    assert d.count() > 0.7 * before
    assert P.run(spark, small).agg(F.countDistinct("doc_id")).first()[0] > 0


def test_pipeline_stages_on_odd_rows(spark, small, odd):
    """Null, empty and very long texts, repeated rows, null ids and empty tables go through every stage."""
    import corpus_pipeline as P
    from seriesmill.llm.common import stored

    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    d = docs(spark, [*odd, odd[5], None], [*range(len(odd)), 5, None]).select(columns)
    for _, stage in P.STAGES[:-1]:
        out = stored(stage(spark, d, small))
        assert out.columns == columns and out.count() > 0
        assert stage(spark, d.limit(0), small).count() == 0
        d = out
    assert {r["doc_id"] for r in d.collect()} >= {0, 3, 7}
    assert P.STAGES[-1][1](spark, d, small).select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
    assert P.STAGES[-1][1](spark, d.limit(0), small).count() == 0
