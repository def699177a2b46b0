"""Mixture-controlled packing (operator 2): deficit round-robin over source queues.

Every partition keeps a queue of documents for each source. A window of `window` tokens is filled in one round: each
source earns its share of the window and is served what it has earned, in whole tokens; what a source has earned and
not received is its deficit and goes on to the next window, and so does what it has received in advance. A partition
fills windows while every source can be served. What it can't place so is dealt out again over the cluster, where the
deficits of all partitions start the second pass; when a source's queue has run dry there, the others share its part.
Only the last windows of the second pass are not full; their sizes are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.bpe import codec, text_groups
from seriesmill.llm.common import stored

_PIECE = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())]
_ROW = [*_PIECE, ("ids", pa.binary()), ("deficit", pa.float64())]
_DDL = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Queue:
    """Documents of one source that wait: what is left of each (key, first id left, ids left, ids in all, whether the key is null), and their ids."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def add(self, docs: np.ndarray, ids: np.ndarray) -> None:
        """docs: five columns; ids: those left of all these documents, one after the other."""
        self.docs.append(docs)
        self.ids.append(ids)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 5), np.int64)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, "<u4")
        self.docs, self.ids = [docs], [ids]
        return docs, ids

    def drop(self, n: int) -> None:
        """Drops the first n ids."""
        docs, ids = self.whole()
        end = np.cumsum(docs[:, 2])
        k = int(np.searchsorted(end, n, "right"))
        docs = docs[k:].copy()
        if len(docs):
            part = n - (int(end[k - 1]) if k else 0)
            docs[0, 1] += part
            docs[0, 2] -= part
        self.docs, self.ids = [docs], [ids[n:]]


class Mixer:
    """Source queues, their deficits, and the plan of windows."""

    def __init__(self, shares: dict[str, float], window: int, least_piece: int, first_sequence: int):
        self.names = list(shares)
        self.place = {s: k for k, s in enumerate(self.names)}
        share = np.array([shares[s] for s in self.names], float)
        self.share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / max(1, len(share)))
        self.window, self.least, self.sequence = window, least_piece, first_sequence
        self.deficit, self.held = np.zeros(len(share)), np.zeros(len(share), np.int64)
        self.queues = [Queue() for _ in self.names]

    def add(self, source: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> None:
        """source: the queue of each document; docs: as in Queue; ids: of all documents, one after the other."""
        end = np.cumsum(docs[:, 2])
        order = np.argsort(source, kind="stable")
        cut = np.flatnonzero(np.diff(source[order], prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = order[a:b]
            n = docs[own, 2]
            at = np.repeat(end[own] - np.cumsum(n), n) + np.arange(int(n.sum()))
            self.queues[int(source[own[0]])].add(docs[own], ids[at])
            self.held[int(source[own[0]])] += int(n.sum())

    def _round(self, size: int, drain: bool) -> np.ndarray | None:
        """What each source is served in a window of size tokens; None if the window can't be filled in proportion."""
        share = self.share
        if drain and (self.held == 0).any():
            share = share * (self.held > 0)
            share = share / share.sum() if share.sum() > 0 else (self.held > 0) / (self.held > 0).sum()
        earned = self.deficit + share * size
        take = np.where(earned >= np.minimum(self.least, np.maximum(self.held, 1)), np.floor(earned + 1e-9), 0).astype(np.int64)
        if drain:
            take = np.minimum(take, self.held)
        if take.sum() > size:
            take = take * size // take.sum()
        short = size - int(take.sum())
        while short > 0:
            room = self.held - take if drain else np.where(take > 0, size, 0) if take.any() else np.full(len(take), size)
            some = np.flatnonzero((room > 0) & (take > 0) if (room * take).any() else room > 0)
            if not len(some):
                return None
            if short < len(some):  # a token each to those that are owed most
                some = some[np.argsort(take[some] - earned[some], kind="stable")[:short]]
                add = np.ones(len(some), np.int64)
            else:
                weight = share[some] if share[some].sum() > 0 else np.ones(len(some))
                add = np.minimum(np.maximum(1, np.floor(short * weight / weight.sum())).astype(np.int64), room[some])
                while add.sum() > short:
                    add[np.argmax(add)] -= min(int(add.sum()) - short, int(add.max()))
            take[some] += add
            short -= int(add.sum())
        if (take > self.held).any():
            return None
        self.deficit = earned - take
        self.held -= take
        return take

    def run(self, drain: bool) -> pa.RecordBatch | None:
        """Fills windows and returns their pieces; without drain only while they can be filled in proportion, and then whole."""
        plan, sizes = [], []
        left = int(self.held.sum())
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1)) if drain else self.window
            before = self.deficit
            take = self._round(size, drain) if size <= left else None
            if take is None:
                self.deficit = before
                break
            plan.append(take)
            sizes.append(size)
            left -= size
        if not plan:
            return None
        alloc = np.array(plan)
        begin = np.cumsum(alloc, 1) - alloc
        cols: list[list] = [[] for _ in range(9)]
        for s in np.flatnonzero(alloc.any(0)).tolist():
            docs, ids = self.queues[s].whole()
            cuts, end = np.cumsum(alloc[:, s]), np.cumsum(docs[:, 2])
            total = int(cuts[-1])
            stop = np.unique(np.concatenate([end[end < total], cuts[cuts > 0]]))
            start = np.concatenate([[0], stop[:-1]])
            doc, win = np.searchsorted(end, start, "right"), np.searchsorted(cuts, start, "right")
            raw = memoryview(ids[:total].tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * start).tolist(), (4 * stop).tolist())]
            own = docs[doc]
            values = own[:, 0], own[:, 1] + start - (end - docs[:, 2])[doc], stop - start, np.array(crc, np.int64), own[:, 3], self.sequence + win, begin[win, s] + start - (cuts - alloc[:, s])[win], np.full(len(doc), s), own[:, 4]
            for c, v in zip(cols, values):
                c.append(v)
            self.queues[s].drop(total)
        self.sequence += len(plan)
        return _pieces([np.concatenate(c) for c in cols], self.names)


def _pieces(cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    key, *numbers, source, null = cols
    arrays = [pa.array(key, mask=null > 0), *[pa.array(x) for x in numbers], pa.array(names, pa.string()).take(pa.array(source))]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _PIECE])


def _keys(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null), and which are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _split(batch: pa.RecordBatch, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, shares: dict[str, float] | None = None, least_piece: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    shares: the target proportion of each source; by default its part of the corpus's UTF-8 bytes, summed over all
    documents. Every source has a queue and a target of its own; a source that is not in shares has the target zero and
    is placed at the end. While it has documents, a source is in every full window, within two tokens of its share, if
    that is at least least_piece tokens; a smaller one comes when it has earned so many, and the others make room for it
    when it does. Every document ends with end_id, so a null or empty text is one piece of one token. Rows that repeat are packed as often as they come, ids may
    be null, a null source is a source of its own, a document of any length runs on
    from window to window, and an empty table gives no pieces. A partition's memory holds its own queues: at most the
    ids of one input partition. The sources are the parts of a mixture: the driver gets one number for each.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"))
    found = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("double").alias("n")).orderBy("source").collect()}
    targets = found if shares is None else dict.fromkeys(found, 0.0) | {s: float(shares[s]) for s in sorted(shares) if s in found}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        mixer = Mixer(targets, window, least_piece, TaskContext.get().partitionId() << 33)
        names = pa.array(mixer.names, pa.string())
        for batch in batches:
            (keys, null), texts = _keys(batch.column(0)), batch.column(1).to_pylist()
            source = pc.index_in(batch.column(2), names).to_numpy(zero_copy_only=False)
            for begin, part in text_groups(texts):
                ids, stops = bpe.encode_flat(part)
                ids = np.insert(ids, stops[1:], end_id).astype("<u4")
                n = np.diff(stops) + 1
                mixer.add(source[begin : begin + len(part)], np.stack([keys[begin : begin + len(part)], np.zeros(len(part), np.int64), n, n, null[begin : begin + len(part)]], 1), ids)
                done = mixer.run(False)
                if done is not None:
                    yield from (_placed(x) for x in _split(done))
        for s, queue in enumerate(mixer.queues):
            own, ids = queue.whole()
            raw, end = ids.tobytes(), np.cumsum(own[:, 2]) * 4
            for i in range(0, len(own), 1000):
                part = own[i : i + 1000]
                blobs = [raw[b - 4 * n : b] for b, n in zip(end[i : i + 1000].tolist(), part[:, 2].tolist())]
                yield _left(part, mixer.names[s], blobs)
        owing = np.flatnonzero(np.abs(mixer.deficit) > 1e-9)
        yield _owing([mixer.names[s] for s in owing], mixer.deficit[owing])

    placed = stored(rows.mapInArrow(first, _DDL + ", ids binary, deficit double"))
    left = placed.where("ids is not null")
    parts = max(1, -(-(left.agg(F.sum("length")).first()[0] or 0) // 4_000_000))
    owed = {r["source"]: r["d"] / parts for r in placed.where("deficit is not null").groupBy("source").agg(F.sum("deficit").alias("d")).collect()}

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(targets, window, least_piece, (1 << 62) + (TaskContext.get().partitionId() << 33))
        mixer.deficit = np.array([owed.get(s, 0.0) for s in mixer.names])
        names = pa.array(mixer.names, pa.string())
        for batch in batches:
            (key, null), start, total = _keys(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            blobs = batch.column(4).to_pylist()
            source = pc.index_in(batch.column(3), names).to_numpy(zero_copy_only=False)
            mixer.add(source, np.stack([key, start, np.array([len(x) // 4 for x in blobs], np.int64), total, null], 1), np.frombuffer(b"".join(blobs), "<u4"))
        done = mixer.run(True)
        if done is not None:
            yield from _split(done)

    again = left.select("id", "start", "doc_tokens", "source", "ids").repartition(parts, F.xxhash64("id", "start")).mapInArrow(second, _DDL)
    return placed.where("sequence_id is not null").drop("ids", "deficit").unionByName(again)


def _row(n: int, **columns) -> pa.RecordBatch:
    """n rows of _ROW; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in _ROW], names=[c for c, _ in _ROW])


def _placed(pieces: pa.RecordBatch) -> pa.RecordBatch:
    return _row(pieces.num_rows, **{n: pieces.column(n) for n in pieces.schema.names})


def _left(docs: np.ndarray, source: str, blobs: list[bytes]) -> pa.RecordBatch:
    return _row(len(docs), id=pa.array(docs[:, 0], mask=docs[:, 4] > 0), start=pa.array(docs[:, 1]), length=pa.array(docs[:, 2]), doc_tokens=pa.array(docs[:, 3]), source=pa.array([source] * len(docs)), ids=pa.array(blobs, pa.binary()))


def _owing(names: list[str], deficit: np.ndarray) -> pa.RecordBatch:
    return _row(len(names), source=pa.array(names, pa.string()), deficit=pa.array(deficit, pa.float64()))
