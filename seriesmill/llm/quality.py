"""Quality by weak labels (operator 6).

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of their vote
patterns (at most 3 to the power of the labellers, whatever the corpus) estimates how often each votes and how often it
is right, without any true label. The posterior of each pattern then labels a bounded sample of documents, on which a
hashed linear scorer is trained; it scores every document from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import U, WORD_BYTE, chunks, flat, mix, span_hashes, word_spans

GOOD, NONE, BAD = 1, 0, -1
#: Name, measure, bad below, good from, good to, bad above: a measure in the good range votes good, beyond the bad limits bad.
LABELLERS = (
    ("length", "words", 1, 40, 1e12, 1e12),
    ("variety", "distinct", 0.25, 0.45, 1e9, 1e9),
    ("symbols", "symbols", -1, -1, 0.03, 0.06),
    ("capitals", "capitals", -1, -1, 0.12, 0.4),
    ("repeats", "neighbours", -1, -1, 0.05, 0.2),
    ("lines", "line_copies", -1, -1, 0.15, 0.4),
    ("word_size", "word_size", 2.5, 3.0, 10.0, 14.0),
    ("digits", "digits", -1, -1, 0.05, 0.5),
)
MEASURES = ("words", "distinct", "symbols", "capitals", "neighbours", "line_copies", "word_size", "digits")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CAPITAL = np.array([65 <= c <= 90 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_PLAIN = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-()?!"])


def measures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of MEASURES for each text, all 0 for an empty one; and words' hashes, each row's first word, the bytes' lengths."""
    n = len(off) - 1
    start, end, first = word_spans(data, off)
    lower = np.where(_CAPITAL[data], data + 32, data).astype(np.uint8)
    words = span_hashes(lower, start, end)
    row = np.repeat(np.arange(n), np.diff(first))
    count, size = np.diff(first).astype(float), np.diff(off).astype(float)
    one = np.maximum(count, 1)
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off]).astype(float)
    order = np.lexsort((words, row))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n) / np.sqrt(one * np.minimum(one, 400)) if n else np.zeros(0)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    visible = np.maximum(total(~_SPACE[data]), 1)
    brk = np.zeros(len(data) + 1, bool)
    brk[off] = True
    brk[1:] |= data == 10
    at = np.flatnonzero(brk)
    a, b = at[:-1], at[1:]
    long = b - a > 10
    a, b = a[long], b[long]
    lines, owner = span_hashes(data, a, b - (data[b - 1] == 10)), np.searchsorted(off, a, "right") - 1
    order = np.lexsort((lines, owner))
    copy = np.zeros(len(lines), bool)
    copy[1:] = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.stack([
        count, distinct, total(~(_SPACE[data] | WORD_BYTE[data] | _PLAIN[data])) / visible, total(_CAPITAL[data]) / visible,
        np.bincount(row[again], minlength=n) / one, np.bincount(owner[order][copy], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1),
        np.bincount(row, weights=end - start, minlength=n) / one, total(_DIGIT[data]) / visible,
    ], 1)
    return out, words, first, size


def votes(m: np.ndarray) -> np.ndarray:
    """A row of GOOD, NONE, BAD of each labeller for each row of measures. A text without words gets only the first one's vote."""
    out = np.zeros((len(m), len(LABELLERS)), np.int8)
    for k, (_, name, low, good, to, high) in enumerate(LABELLERS):
        x = m[:, MEASURES.index(name)]
        out[:, k] = np.where((x < low) | (x > high), BAD, np.where((x >= good) & (x <= to), GOOD, NONE))
    out[m[:, 0] == 0, 1:] = NONE
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def votes_of(pattern: np.ndarray, k: int) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(k)) % 3 - 1


class LabelModel:
    """Each class's rates of the labellers' votes, and the classes' shares. Class 0 is good, class k + 1 bad in the way that labeller k sees.

    One labeller sees one kind of junk, so a bad document gets good votes from most of them; a single bad class would
    fit one kind and leave the others among the good. What is known beforehand enters as priors that count as many
    documents as `trust` says, in parts of all: that a labeller seldom votes against a good document (`alarm`), and
    often against its own kind of bad ones. The votes move every rate from there.
    """

    def __init__(self, labellers: int, alarm: float = 0.002, trust: float = 0.25):
        self.share = np.array([0.85] + [0.15 / labellers] * labellers)
        self.rate = np.tile(np.array([alarm, 0.1, 0.9 - alarm]), (labellers + 1, labellers, 1))
        for k in range(labellers):
            self.rate[k + 1, k] = 0.8, 0.1, 0.1
        self.prior, self.trust = self.rate.copy(), trust

    def classes(self, v: np.ndarray) -> np.ndarray:
        """The probability of each class for documents with these votes."""
        own = np.arange(v.shape[1])
        log = np.log(self.share)[None] + np.stack([np.log(r[own, v + 1]).sum(1) for r in self.rate], 1)
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability that a document with these votes is good."""
        return self.classes(v)[:, 0]

    def fit(self, v: np.ndarray, n: np.ndarray, rounds: int = 200) -> LabelModel:
        """v: different vote patterns; n: how often each comes."""
        votes_against = np.stack([v == k for k in (BAD, NONE, GOOD)], 2).astype(float)
        for _ in range(rounds):
            w, before = self.classes(v) * n[:, None], self.rate.copy()
            total = w.sum(0)
            self.share = (total + 0.1) / (total + 0.1).sum()
            seen = np.einsum("pc,pkt->ckt", w, votes_against) + self.prior * (self.trust * total + 1)[:, None, None]
            self.rate = seen / seen.sum(2, keepdims=True)
            if np.abs(self.rate - before).max() < 1e-7:
                break
        return self

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        bad = self.share[1:, None]
        right = self.share[0] * self.rate[0][:, 2] + (bad * self.rate[1:, :, 0]).sum(0)
        return right / (right + self.share[0] * self.rate[0][:, 0] + (bad * self.rate[1:, :, 2]).sum(0))


BITS = 16


def hashed_features(m: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of each text: its words, with a weight of 1 in all, and ten steps of each measure."""
    n = len(m)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    step = np.minimum((m / np.array([50, 0.1, 0.02, 0.05, 0.02, 0.05, 1, 0.02])).astype(np.int64), 10)
    marks = mix(step.astype(np.uint64) + (np.arange(m.shape[1], dtype=np.uint64) << U(32)) + U(1)).ravel() >> U(64 - BITS)
    return (
        np.concatenate([row, np.repeat(np.arange(n), m.shape[1])]), np.concatenate([words >> U(64 - BITS), marks]).astype(np.int64),
        np.concatenate([1 / np.maximum(count, 1)[row], np.full(len(marks), 0.5)]),
    )


def fit_linear(row, bucket, value, target: np.ndarray, weight: np.ndarray, steps: int = 800, rate: float = 0.5, shrink: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, with the bias last: `steps` steps at least, and 12 times over the rows."""
    w, g = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    n = len(target)
    order = np.argsort(row, kind="stable")
    row, bucket, value = row[order], bucket[order], value[order]
    first = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(2)
    parts, perm = [], rng.permutation(n)
    for k in range(0, n, 512):  # a batch's rows stay together, so that its buckets are sorted once
        own = perm[k : k + 512]
        c = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
        used, back = np.unique(bucket[at], return_inverse=True)
        parts.append((own, np.repeat(np.arange(len(own), dtype=np.int32), c), back.astype(np.int32), used, value[at]))
    for _ in range(max(12, -(-steps // max(1, len(parts))))):
        for k in rng.permutation(len(parts)):
            own, r, back, used, x = parts[k]
            z = np.bincount(r, weights=w[used][back] * x, minlength=len(own)) + w[-1]
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[own]) * weight[own] / len(own)
            d = np.bincount(back, weights=e[r] * x, minlength=len(used)) + shrink * w[used]
            g[used] += d * d
            w[used] -= rate * d / np.sqrt(g[used])
            g[-1] += e.sum() ** 2
            w[-1] -= rate * e.sum() / np.sqrt(g[-1])
    return w


def _each(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        data, off = flat(batch.column(column))
        for i, j in chunks(off, 1 << 19):
            m, words, first, _ = measures(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield batch.slice(i, j - i), m, words, first


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, most_rows: int = 8_000, keep_from: float = 0.5) -> DataFrame:
    """struct `row` of the columns carry (all, by default), votes (array), posterior, score (0 to 1) and kept, for each row.

    posterior: the label model's probability that a document with these votes is good, from the votes of all documents;
    score: the linear scorer's, trained on at most most_rows documents (those whose ids and texts have the smallest
    hashes; rows that repeat id and text count once there). Null text is empty; a text without words is voted bad for its length only. Repeated rows count as often as
    they come, null ids are rows like others, an empty table gives an empty result.
    """
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for _, m, _, _ in _each(batches, "text"):
            for p, n in zip(*np.unique(pattern_of(votes(m)), return_counts=True)):
                seen[int(p)] = seen.get(int(p), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    tally = rows.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([r["pattern"] for r in tally], np.int64)
    model = LabelModel(len(LABELLERS))
    if len(patterns):
        model.fit(votes_of(patterns, len(LABELLERS)), np.array([r["n"] for r in tally], float))

    small = docs.select(key.alias("k")).distinct().orderBy("k").limit(most_rows)  # a bounded sample by hash
    edge = small.agg(F.max("k")).first()[0]
    sample = docs.select(F.col(f"`{text_col}`").alias("text"), key.alias("k")).where(F.col("k") <= F.lit(edge)).dropDuplicates(["k"]) if edge is not None else docs.limit(0).select(F.lit("").alias("text"), F.lit(0).alias("k"))

    def train(t: pa.Table) -> pa.Table:
        parts = [(v, hashed_features(m, w, f)) for b in [t.sort_by([("k", "ascending"), ("text", "ascending")]).slice(0, most_rows)] for _, m, w, f in _each(b.to_batches(), "text") for v in [votes(m)]]
        p = model.posterior(np.concatenate([v for v, _ in parts]))
        base = np.cumsum([0, *[len(v) for v, _ in parts]])
        row, bucket, value = (np.concatenate(x) for x in zip(*[(f[0] + b, f[1], f[2]) for (_, f), b in zip(parts, base)]))
        w = fit_linear(row, bucket, value, p, np.ones(len(p)))
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    got = sample.groupBy(F.lit(1).alias("g")).applyInArrow(train, "w binary").collect()
    weights = np.frombuffer(got[0]["w"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m, words, first in _each(batches, "text"):
            v = votes(m)
            r, b, x = hashed_features(m, words, first)
            z = np.bincount(r, weights=weights[b] * x, minlength=len(m)) + weights[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(v.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(model.posterior(v)), pa.array(s), pa.array(s >= keep_from)], names=["row", "votes", "posterior", "score", "kept"])

    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, votes array<int>, posterior double, score double, kept boolean")
