"""Near-duplicates by consistent weighted sampling (operator 3).

A document is its set of five-word shingles, weighted by TF-IDF over the whole corpus, w = (1 + ln tf)(1 + idf ln(N/df) / ln N).
The inverse document frequency is damped by idf (0.1): shingles that a family of copies shares are frequent because of
the copies, and with full weight for rare shingles a large family would not be similar to itself any more.

1. Blocks of documents send their shingles' hashes to buckets (ordered, as differences), which return the document
   frequency of those that occur twice or more.
2. What two documents share has a frequency of two or more, so a document in which such shingles make up less than the
   threshold has no near-duplicate. The others get `samples` weighted samples (improved consistent weighted sampling).
3. Bands of samples make buckets of candidates. First every member is compared with its bucket's head; the verified
   links make components. Then members of one bucket that are in different components are compared with each other, in
   pieces of bounded size; a task returns only links that join components, so no pairs are written out, and no link
   between components is left out.
4. A candidate pair counts as a link if its weighted Jaccard similarity, from the shingles themselves, reaches the threshold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import U, _A, _B, _C, blocks_for, mix, shingle_hashes, stored, words_of
from seriesmill.llm.components import components

_LOW16, _ROWS = U(0xFFFF), "block int, bucket int, blob binary"


def weights(tf: np.ndarray, df: np.ndarray, total: int, idf: float) -> np.ndarray:
    return (1 + np.log(tf)) * (1 + idf * np.log(np.maximum(total / df, 1.0)) / max(np.log(total), 1e-9) if total > 1 else np.ones(len(tf)))


def block_shingles(texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hash, row and count of each row's different shingles, ordered by hash and row."""
    words, first, _ = words_of(texts)
    h, row = shingle_hashes(words, first, n)
    parts = []
    for base in range(0, len(first) - 1, 1 << 16):
        a, b = np.searchsorted(row, [base, base + (1 << 16)])
        key = np.sort((h[a:b] & ~_LOW16) | (row[a:b] - base).astype(np.uint64))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        parts.append((key[at] >> U(16), (key[at] & _LOW16).astype(np.int64) + base, np.diff(np.append(at, len(key)))))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    h, row, tf = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((row, h))
    return h[order], row[order], tf[order]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ordered different integers below 2^48: their number, and their differences in 4 bytes each if they fit, else 8."""
    d = np.diff(values, prepend=U(0))
    wide = len(d) and int(d[1:].max(initial=0)) >> 32
    return bytes([8 if wide else 4]) + (values[:1].tobytes() + (d[1:].tobytes() if wide else d[1:].astype(np.uint32).tobytes()))


def unpack_sorted(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob, np.uint64, 1, 1)
    d = np.frombuffer(blob, np.uint64 if blob[0] == 8 else np.uint32, -1, 9).astype(np.uint64)
    return np.cumsum(np.concatenate([first, d]))


def samples(h: np.ndarray, w: np.ndarray, first: np.ndarray, k: int, seed: int = 17) -> np.ndarray:
    """k consistent weighted samples of each set; h, w: elements and weights, set by set; first: where each begins, none empty."""
    out = np.empty((len(first), k), np.uint32)
    lw = np.log(w).astype(np.float32)
    size = np.diff(np.append(first, len(h)))
    scale = np.float32(2.0**-24)
    odd = np.random.default_rng(seed).integers(0, 2**63, (k, 2), dtype=np.uint64) * U(2) + U(1)
    for j in range(k):
        x = h * odd[j, 0]
        x ^= x >> U(31)
        x *= _A
        x ^= x >> U(29)
        y = x * odd[j, 1]
        y ^= y >> U(32)
        y *= _B
        y ^= y >> U(30)
        take = lambda z, s: ((z >> U(s)) & U(0xFFFFFF)).astype(np.float32) * scale + np.float32(2.0**-26)
        r = -np.log(take(x, 0) * take(x, 40))
        c = -np.log(take(y, 0) * take(y, 40))
        beta = (((x >> U(24)) & U(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        t = np.floor(lw / r + beta)
        a = np.log(c) - r * (t - beta + 1)
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), size))
        hit = hit[np.searchsorted(hit, first)]
        out[:, j] = (mix(h[hit] + t[hit].astype(np.int64).astype(np.uint64) * _C + U(j)) >> U(32)).astype(np.uint32)
    return out


def jaccard(ha: np.ndarray, wa: np.ndarray, ta: float, hb: np.ndarray, wb: np.ndarray, tb: float) -> float:
    """Weighted Jaccard similarity from the ordered shared shingles and the sums of all weights."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / max(ta + tb - both, 1e-12)


def _features(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 10
    low, high = np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.uint16, n, 4 * n)
    return low.astype(np.uint64) | (high.astype(np.uint64) << U(32)), np.frombuffer(blob, np.float32, n, 6 * n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, n_samples: int = 64, rows: int = 4, idf: float = 0.1, agree_from: float = 0.45, block_bytes: int = 4 << 20, piece: int = 256) -> DataFrame:
    """id, class_id, class_size, kept: one row for each row of docs; class_id is the smallest id of its class.

    Documents are in one class if a chain of links of at least `threshold` joins them. idf: how much rare shingles weigh
    more than frequent ones. Candidates that agree in fewer of the samples than agree_from aren't verified: for 64
    samples and a threshold of 0.8 that is six standard deviations below what a link has; 0 verifies all. Words are runs of letters, digits
    and characters outside ASCII, in lower case; a text of 1 to words-1 words is one shingle, and a text without words
    (null, empty, punctuation) is like no other. A row with a null id is in no class (class_id null) and kept. Rows that
    repeat an id are rows of one class, and all of them say kept if their id is the class's. Empty tables give an empty
    result. A text is held whole, whatever its length; other columns are left out.
    """
    me, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blocks, total = blocks_for(docs, f"`{text_col}`", block_bytes), docs.count()
    dealt = docs.select(F.pmod(F.xxhash64(me, text), F.lit(blocks)).cast("int").alias("block"), me.alias("id"), text.alias("text"))

    def buckets_of(h: np.ndarray) -> np.ndarray:
        return ((h >> U(16)) * U(blocks) >> U(32)).astype(np.int64)

    def in_order(t: pa.Table) -> pa.Table:
        return t.sort_by([("id", "ascending"), ("text", "ascending")])

    def send_hashes(t: pa.Table) -> pa.Table:
        h, _, _ = block_shingles(in_order(t).column("text").combine_chunks(), words)
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        df, h = np.diff(np.append(at, len(h))), h[at]
        where = buckets_of(h)
        cut = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
        block, out = t.column("block")[0].as_py(), []
        for a, b in zip(cut[:-1], cut[1:]):
            more = np.flatnonzero(df[a:b] > 1)  # most occur in one document of the block
            tail = zlib.compress(np.concatenate([more, df[a:b][more]]).astype("<u4").tobytes(), 1)
            out.append((block, int(where[a]), len(tail).to_bytes(4, "little") + tail + pack_sorted(h[a:b])))
        return _blobs(out)

    def answer(t: pa.Table) -> pa.Table:
        own, hs, ns = [], [], []
        for block, blob in zip(t.column("block").to_pylist(), t.column("blob").to_pylist()):
            z = int.from_bytes(blob[:4], "little")
            h = unpack_sorted(blob[4 + z :])
            more = np.frombuffer(zlib.decompress(blob[4 : 4 + z]), "<u4").reshape(2, -1)
            n = np.ones(len(h), np.int64)
            n[more[0]] = more[1]
            own.append((block, len(h)))
            hs.append(h)
            ns.append(n)
        h = np.concatenate(hs)
        order = np.argsort(h)
        ordered = h[order]
        run = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        sums = np.bincount(run, weights=np.concatenate(ns)[order]).astype(np.int64)
        df = np.empty(len(h), np.int64)
        df[order] = sums[run]
        bucket, out, at = t.column("bucket")[0].as_py(), [], 0
        for block, n in own:
            mine, at = df[at : at + n], at + n
            more = np.flatnonzero(mine > 1)
            out.append((block, bucket, n.to_bytes(4, "little") + zlib.compress(np.diff(more, prepend=0).astype("<u4").tobytes() + mine[more].astype("<u4").tobytes(), 1)))
        return _blobs(out)

    def describe(t: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["id", "digest", "total", "shared", "sample", "features"]
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()))})
        t = in_order(t)
        ids = t.column("id").to_pylist()
        h, row, tf = block_shingles(t.column("text").combine_chunks(), words)
        run = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        df_of, at = np.ones(int(run[-1]) + 1 if len(run) else 0, np.int64), 0
        for blob in (x for _, x in sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))):
            n = int.from_bytes(blob[:4], "little")
            gap, value = np.frombuffer(zlib.decompress(blob[4:]), "<u4").reshape(2, -1).astype(np.int64)
            df_of[at + np.cumsum(gap)] = value
            at += n
        df, size = df_of[run], len(ids)
        w = weights(tf, df, total, idf)
        sums, shared = np.bincount(row, weights=w, minlength=size).astype(float), np.bincount(row, weights=w * (df > 1), minlength=size).astype(float)
        able = (sums > 0) & (shared >= threshold * sums * (1 - 1e-9)) & np.array([i is not None for i in ids])
        pick = np.flatnonzero(able[row])
        pick = pick[np.argsort(row[pick], kind="stable")]
        h, row, w, df, tf = h[pick], row[pick], w[pick], df[pick], tf[pick]
        digest = np.zeros(size, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        if len(first):
            digest[row[first]] = mix(np.add.reduceat(mix(h * _A + tf.astype(np.uint64) * _C), first))
        mine = row[first]
        _, once = np.unique(digest[mine], return_index=True)
        once.sort()
        keep = np.isin(row, mine[once]) if len(once) < len(mine) else np.ones(len(row), bool)
        sample: list = [None] * size
        feature: list = [None] * size
        if len(once):
            h, row, w, df = h[keep], row[keep], w[keep], df[keep]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            got = samples(h, w, first, n_samples)
            for k, (a, b) in enumerate(zip(first, np.append(first[1:], len(row)))):
                s = df[a:b] > 1
                hs = h[a:b][s]
                sample[row[a]] = got[k].tobytes()
                feature[row[a]] = (hs & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (hs >> U(32)).astype(np.uint16).tobytes() + w[a:b][s].astype(np.float32).tobytes()
        marks = digest.view(np.int64).tolist()
        return pa.table({"id": pa.array(ids, pa.int64()), "digest": pa.array([m if a else None for m, a in zip(marks, able)], pa.int64()), "total": pa.array(sums), "shared": pa.array(shared), "sample": pa.array(sample, pa.binary()), "features": pa.array(feature, pa.binary())})

    hashes = dealt.groupBy("block").applyInArrow(send_hashes, _ROWS)
    answers = hashes.groupBy("bucket").applyInArrow(answer, _ROWS)
    seen = stored(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(describe, "id long, digest long, total double, shared double, sample binary, features binary"))

    # one node for each different content, named by its smallest id
    nodes = stored(seen.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.max("sample").alias("sample"), F.max("total").alias("total"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("copies")))
    features = seen.where("features is not null").groupBy("digest").agg(F.max("features").alias("features"))
    full = nodes.select("digest", "node", "total").join(features, "digest").select("node", "total", "features")
    size = 4 * rows
    bands = [F.xxhash64(F.lit(i), F.substring("sample", i * size + 1, size)) for i in range(n_samples // rows)]
    banded = nodes.select("node", F.posexplode(F.array(*bands)).alias("band", "key"))
    # what is grouped is a table before it is joined back, so that Spark can split a frequent key's rows in the join
    heads = stored(banded.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stored(banded.join(heads, "key"))
    agree = lambda a, b: sum(F.when(F.substring(a, 4 * i + 1, 4) == F.substring(b, 4 * i + 1, 4), 1).otherwise(0) for i in range(n_samples))

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold. b's features travel to a's; a has as many places as it has hundreds of pairs."""
        sized = pairs.join(stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 100).cast("int").alias("salts"))), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
        far = sized.select("a", "salt", F.col("b").alias("node")).join(full, "node").select("a", "salt", "node", "total", "features")
        near = sized.select("a", "salt").distinct().withColumnRenamed("a", "node").join(full, "node").select(F.col("node").alias("head"), F.col("salt").alias("head_salt"), F.col("total").alias("head_total"), F.col("features").alias("head_features"))

        def verify(one: pa.Table, many: pa.Table) -> pa.Table:
            out: list[int] = []
            if one.num_rows and many.num_rows:
                ha, wa = _features(one.column("head_features")[0].as_py())
                ta = one.column("head_total")[0].as_py()
                for node, tb, x in zip(many.column("node").to_pylist(), many.column("total").to_pylist(), many.column("features")):
                    hb, wb = _features(x.as_py())
                    if jaccard(ha, wa, ta, hb, wb, tb) >= threshold - 1e-6:
                        out.append(node)
            a = one.column("head")[0].as_py() if one.num_rows else None
            return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

        return near.groupBy("head", "head_salt").cogroup(far.groupBy("a", "salt")).applyInArrow(verify, "a long, b long")

    facts = ("sample", "total", "shared")
    with_facts = lambda df, c: df.join(nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in facts]), c)
    # two documents share no more than the smaller of their shingles of frequency two or more
    within = lambda m, t: m >= (threshold - 1e-6) * (t - m)
    stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = with_facts(with_facts(stars, "a"), "b").where(within(F.least("shared_a", "shared_b"), F.col("total_a") + F.col("total_b"))).where(agree("sample_a", "sample_b") >= int(agree_from * n_samples)).select("a", "b")
    found = stored(links(stored(stars)))
    roots = components(found)

    # Members of one bucket that are in different components so far: at least one of a pair is outside the bucket's largest
    # component. So these outsiders, in pieces, meet all members, in pieces; a bucket with few of them costs little more than its members.
    placed = members.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("big"), F.sum("c").alias("n")).where(F.col("n") > F.col("big.c"))
    mixed = stored(mixed.select("key", F.col("big.root").alias("big"), F.ceil(F.col("n") / piece).cast("int").alias("all"), F.ceil((F.col("n") - F.col("big.c")) / piece).cast("int").alias("outer")))
    cross = placed.join(mixed, "key").join(nodes.select("node", *facts), "node").withColumn("outside", F.col("root") != F.col("big"))
    deal = lambda salt, n: F.pmod(F.xxhash64("node", "key", F.lit(salt)), F.col(n)).cast("int")
    left = cross.where("outside").withColumn("left", F.lit(True)).withColumn("p", deal(1, "outer")).withColumn("q", F.explode(F.expr("sequence(0, all - 1)")))
    right = cross.withColumn("left", F.lit(False)).withColumn("q", deal(2, "all")).withColumn("p", F.explode(F.expr("sequence(0, outer - 1)")))
    cross = left.unionByName(right).select("key", "band", "p", "q", "left", "outside", "node", "root", *facts)

    def compare(t: pa.Table) -> pa.Table:
        """Links between a piece of a bucket's outsiders and one of its members; of those that join the same two components here, one."""
        band = t.column("band")[0].as_py()
        node, root = (np.array(t.column(c).to_pylist(), np.int64) for c in ("node", "root"))
        outsiders, outside = (np.array(t.column(c).to_pylist(), bool) for c in ("left", "outside"))
        total, shared = (np.array(t.column(c).to_pylist()) for c in ("total", "shared"))
        s = np.frombuffer(b"".join(t.column("sample").to_pylist()), np.uint32).reshape(-1, n_samples)
        _, part = np.unique(root, return_inverse=True)
        left, right = np.flatnonzero(outsiders), np.flatnonzero(~outsiders)
        feature: dict[int, tuple] = {}
        out: list[tuple[int, int]] = []
        for i in left:
            js = right[(part[right] != part[i]) & (~outside[right] | (node[right] > node[i]))]  # two outsiders meet twice and count once
            js = js[within(np.minimum(shared[js], shared[i]), total[js] + total[i])]
            same = s[js] == s[i]
            first = same.reshape(len(js), n_samples // rows, rows).all(2).argmax(1)  # a pair counts in the first bucket that it shares
            js = js[(first == band) & (same.sum(1) >= int(agree_from * n_samples))]
            for j in js:
                if part[i] == part[j]:
                    continue
                for k in (i, j):
                    if k not in feature:
                        feature[k] = _features(t.column("features")[int(k)].as_py())
                if jaccard(*feature[i], total[i], *feature[j], total[j]) >= threshold - 1e-6:
                    out.append((int(node[i]), int(node[j])))
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    more = stored(cross.join(full.select("node", "features"), "node").groupBy("key", "p", "q").applyInArrow(compare, "a long, b long"))
    if not more.isEmpty():
        roots = components(found.unionByName(more))
    # sizes of classes from the numbers of copies of their contents; only rows of contents that are in a class are joined
    classes = nodes.join(roots, "node", "left").select("digest", "copies", F.coalesce("root", "node").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    classes = classes.join(sizes, "class_id").where("class_size > 1").select("digest", "class_id", "class_size")
    out = seen.select("id", "digest").join(classes, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))


def _blobs(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 3
    return pa.table({"block": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "blob": pa.array(cols[2], pa.binary())})
