"""Toxicity by a factorization machine over hashed terms (operator 10).

A term is a lower-cased word or its first 4, 5 or 6 bytes, as a 64-bit hash, and falls into one of 2^18 buckets; a
document has each bucket once. The machine has a weight and a vector for each bucket, whatever its terms say alone, so
a pair of terms may count for more than both alone (an insult together with the mention of a group), which additive
weights cannot express. The pairs' part is divided by the root of the number of a document's terms, as pairs grow with
the square of a text's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import U, chunks, flat, span_hashes, stored, word_spans

PREFIXES = (4, 5, 6)


def term_hashes(arr) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of rows: first row, end, and the hash and row of every term, repeats included."""
    data, off = flat(pc.utf8_lower(pc.fill_null(arr, "")))
    for i, j in chunks(off, 1 << 19):
        own = off[i : j + 1] - off[i]
        part = data[off[i] : off[j]]
        start, end, first = word_spans(part, own)
        row = np.repeat(np.arange(i, j), np.diff(first))
        a, b, r, kind = [start], [end], [row], [np.zeros(len(start), np.uint64)]
        for k in PREFIXES:
            long = np.flatnonzero(end - start >= k)
            a.append(start[long])
            b.append(start[long] + k)
            r.append(row[long])
            kind.append(np.full(len(long), k, np.uint64))
        yield i, j, span_hashes(part, np.concatenate(a), np.concatenate(b)) ^ np.concatenate(kind), np.concatenate(r)


class FactorizationMachine:
    """Logistic factorization machine over sets of terms, trained in a fixed order. terms: those it has; None: 2^bits buckets for all."""

    def __init__(self, terms: np.ndarray | None = None, rank: int = 8, seed: int = 5, bits: int = 18):
        self.terms, self.bits = None if terms is None else np.sort(terms.astype(np.uint64)), bits
        self.size = 1 << bits if terms is None else len(terms)
        self.bias, self.linear = 0.0, np.zeros(self.size)
        self.vectors = np.random.default_rng(seed).normal(0, 0.01, (self.size, rank))

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h the machine has, and their places."""
        if self.terms is None:
            return np.arange(len(h)), (h * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), self.size - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        return hit, at[hit]

    def sets(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of each row's different terms, ordered."""
        which, at = self.places(h)
        both = np.unique(row[which].astype(np.int64) * self.size + at)
        return both // max(1, self.size), both % max(1, self.size)

    def margin(self, row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
        """Bias, weights of a row's terms, and the products of the vectors of all pairs of them over the root of their number."""
        out = self.bias + np.bincount(row, weights=self.linear[place], minlength=rows)
        scale = 0.5 / np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))
        for f in range(self.vectors.shape[1]):
            v = self.vectors[place, f]
            s = np.bincount(row, weights=v, minlength=rows)
            out += scale * (s * s - np.bincount(row, weights=v * v, minlength=rows))
        return out

    def fit(
        self, row: np.ndarray, place: np.ndarray, label: np.ndarray, epochs: int = 20, joint: int = 4, visits: float = 4e6, batch: int = 256,
        rate: float = 0.3, vector_rate: float = 0.1, sparse: float = 1.0, penalties: tuple[float, ...] = (1e-3, 1e-2), seed: int = 6,
    ) -> None:
        """row: ordered rows of the terms in place; label: 0 or 1 of each row.

        First the weights alone, `epochs` times over the rows, by AdaGrad with an L1 penalty of `sparse` rows' evidence: a
        start from which vectors learn what weights leave open. From there weights and vectors together, `joint` times
        over the rows (more often, up to `visits` terms, if there are few), once for each penalty on the vectors. An
        eighth of the rows is held back; of the states with trained vectors the one with the least loss on it stays, which
        chooses the penalty. A bucket that no two rows share has no vector, as its pairs can't be told from chance.
        """
        n, rank = len(label), self.vectors.shape[1]
        label = label.astype(float)
        self.bias = float(np.log((label.sum() + 0.5) / (n - label.sum() + 1.5)))
        start = self.vectors.copy()
        often = np.bincount(place, minlength=self.size) >= 2
        start[~often] = 0
        self.vectors = start.copy()
        if not n or not len(place):
            return
        first, rng = np.searchsorted(row, np.arange(n + 1)), np.random.default_rng(seed)
        order = rng.permutation(n)

        def parts(rows: np.ndarray) -> list[tuple]:
            """Stretches of rows: labels, row and place of each term, the buckets used, and the same for the terms that have vectors, by row and by bucket."""
            out = []
            for k in range(0, len(rows), batch):
                own = rows[k : k + batch]
                count = first[own + 1] - first[own]
                at = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                used, back = np.unique(place[at], return_inverse=True)
                r = np.repeat(np.arange(len(own), dtype=np.int32), count)
                vr, (vused, vback) = r[often[place[at]]], np.unique(place[at][often[place[at]]], return_inverse=True)
                by = np.argsort(vback, kind="stable").astype(np.int32)
                full = np.unique(vr, return_index=True)
                out.append((label[own], r, back.astype(np.int32), used.astype(np.int32), 1 / np.sqrt(np.maximum(count, 1)), vr, vback.astype(np.int32), vused.astype(np.int32), full, by, np.searchsorted(vback[by], np.arange(len(vused)))))
            return out

        held, mine = parts(order[: n // 8]), parts(order[n // 8 :])
        w, v = self.linear, self.vectors

        def forward(part: tuple, vectors: bool) -> tuple[np.ndarray, np.ndarray]:
            """Margins, and sums of vectors, of a part's rows."""
            y, r, back, used, scale, vr, vback, vused, (rows, starts), _, _ = part
            z, s = np.bincount(r, weights=w[used][back], minlength=len(y)) + self.bias, np.zeros((len(y), rank))
            if vectors and len(vr):
                x = v[vused][vback]
                s[rows] = np.add.reduceat(x, starts)
                z[rows] += 0.5 * scale[rows] * ((s[rows] ** 2).sum(1) - np.add.reduceat((x * x).sum(1), starts))
            return z, s

        def loss(vectors: bool) -> float:
            return float(sum(np.logaddexp(0, -forward(p, vectors)[0] * (2 * p[0] - 1)).sum() for p in held))

        def learn(rounds: int, vectors: bool, shrink: float, squares: np.ndarray, bias_squares: float) -> tuple:
            """The state with the least held-back loss after any of the rounds."""
            vector_squares, kept = np.full(v.shape if vectors else (0, rank), 1e-4), None
            for _ in range(rounds):
                for k in rng.permutation(len(mine)):
                    y, r, back, used, scale, vr, vback, vused, _, by, starts = mine[k]
                    z, s = forward(mine[k], vectors)
                    e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                    g = e.mean()
                    bias_squares += g * g
                    self.bias -= rate * g / np.sqrt(bias_squares)
                    g = np.bincount(back, weights=e[r], minlength=len(used)) / len(y)
                    squares[used] += g * g
                    step = rate / np.sqrt(squares[used])
                    x = w[used] - step * g
                    w[used] = np.sign(x) * np.maximum(np.abs(x) - step * sparse / n, 0)
                    if vectors and len(vr):
                        x, er = v[vused], (e * scale)[vr][by]
                        g = (np.add.reduceat(er[:, None] * s[vr[by]], starts) - np.add.reduceat(er, starts)[:, None] * x) / len(y) + shrink * x
                        vector_squares[vused] += g * g
                        v[vused] = x - vector_rate * g / np.sqrt(vector_squares[vused])
                now = loss(vectors)
                if kept is None or now < kept[0]:
                    kept = (now, w.copy(), v.copy() if vectors else None, self.bias, squares.copy(), bias_squares)
            return kept

        _, alone, _, bias, steps, bias_steps = learn(epochs, False, 0.0, np.full(self.size, 1e-4), 1e-8)
        rounds, best = max(joint, min(60, int(visits / len(place)))), None
        for shrink in penalties:
            w[:], v[:], self.bias = alone, start, bias
            got = learn(rounds, True, shrink, steps.copy(), bias_steps)
            if best is None or got[0] < best[0]:
                best = got
        _, self.linear, self.vectors, self.bias, _, _ = best

    def save(self) -> bytes:
        head = json.dumps({"bias": self.bias, "terms": None if self.terms is None else len(self.terms), "bits": self.bits, "rank": self.vectors.shape[1]}).encode()
        terms = b"" if self.terms is None else self.terms.tobytes()
        return len(head).to_bytes(4, "little") + head + terms + self.linear.astype(np.float32).tobytes() + self.vectors.astype(np.float32).tobytes()

    @classmethod
    def load(cls, data: bytes) -> FactorizationMachine:
        n = int.from_bytes(data[:4], "little")
        head = json.loads(data[4 : 4 + n])
        k, rank, at = head["terms"], head["rank"], 4 + n
        out = cls(None if k is None else np.frombuffer(data[at : at + 8 * k], np.uint64), rank, bits=head["bits"])
        at += 8 * (k or 0)
        out.bias = head["bias"]
        out.linear = np.frombuffer(data, np.float32, out.size, at).astype(np.float64)
        out.vectors = np.frombuffer(data, np.float32, out.size * rank, at + 4 * out.size).astype(np.float64).reshape(out.size, rank)
        return out


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 8_000, train_on: F.Column | None = None) -> FactorizationMachine:
    """A machine for labels, from at most most_rows labelled rows (those whose ids have the smallest hashes).

    Rows with null id or label are left out; of several labels of an id the largest counts; of equal texts one is used,
    so groups of copies don't count as evidence many times over. All terms of the sample take part. The machine is fitted in
    one task, which gets the sample's buckets, 4 bytes each. Without labels the machine scores below one half.
    """
    mine = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y is not null")
    if train_on is not None:
        mine = mine.where(train_on)
    ids = mine.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), "id")
    once = sample.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.max(F.struct("y", "text")).alias("x"))
    sample = stored(once.orderBy("digest").limit(most_rows).select(F.col("x.text").alias("text"), (F.col("x.y") > 0).cast("int").alias("y")))  # an id may have many texts

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorizationMachine(rank=0)
        for batch in batches:
            terms: list = [b""] * batch.num_rows
            for i, j, h, row in term_hashes(batch.column(0)):
                r, p = own.sets(h, row)
                cut = np.searchsorted(r, np.arange(i, j + 1))
                for k in range(i, j):
                    terms[k] = p[cut[k - i] : cut[k - i + 1]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(terms, pa.binary())], names=["y", "terms"])

    def fit(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("y").to_pylist(), t.column("terms").to_pylist()))
        label, size = np.array([y for y, _ in rows], np.float64), [len(x) // 4 for _, x in rows]
        place = np.frombuffer(b"".join(x for _, x in rows), np.int32)
        del rows
        machine = FactorizationMachine()
        machine.fit(np.repeat(np.arange(len(size), dtype=np.int32), size), place, label)
        return pa.table({"model": pa.array([machine.save()], pa.binary())})

    got = sample.mapInArrow(features, "y int, terms binary").groupBy(F.lit(1).alias("g")).applyInArrow(fit, "model binary").collect()
    if got:
        return FactorizationMachine.load(bytes(got[0]["model"]))
    machine = FactorizationMachine()
    machine.fit(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """struct `row` of the columns carry (all, by default), and score (0 to 1). Null text is empty; its score is that of no terms."""
    model = machine.save()
    names = docs.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorizationMachine.load(model)
        for batch in batches:
            margin = np.full(batch.num_rows, own.bias)
            for i, j, h, row in term_hashes(batch.column(1)):
                r, p = own.sets(h, row)
                margin[i:j] = own.margin(r - i, p, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
