"""Exact dedup over a cuckoo-filter index (operator 4).

Digests are indexed twice: each input partition folds its own copies (so a text that fills a third of the corpus
leaves a partition as one row), then each shard of the digest space folds what the partitions sent. Both folds run on
`CuckooIndex`: the filter answers "never seen" without touching the store, a hit is verified against the stored
digests of its two buckets, and a full filter doubles and is refilled from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import stored

#: Runs of these become one space before texts are compared.
SPACE = r"[\x20\x09-\x0D]+"


class CuckooIndex:
    """Live keys (bytes of at least 16) with a value each; insert, look up and delete.

    slots: fingerprints of 16 bits, four to a bucket, 0 is free. store: for each bucket the keys that belong to it,
    so memory is bounded by the keys given to one index. Deleting the last copy of a key frees its fingerprint.
    """

    WIDTH, KICKS = 4, 200

    def __init__(self, buckets: int = 256):
        self._reset(buckets)
        self.size = self.resizes = self.verified = 0

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = np.zeros((buckets, self.WIDTH), np.uint16).tolist()
        self.store: list[dict | None] = [None] * buckets

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995) & self.mask

    def _put(self, mark: int, one: int, two: int) -> bool:
        for at in (one, two):
            row = self.slots[at]
            if 0 in row:
                row[row.index(0)] = mark
                return True
        at = two
        for k in range(self.KICKS):
            row = self.slots[at]
            row[k & 3], mark = mark, row[k & 3]
            at ^= (mark * 0x5BD1E995) & self.mask
            if 0 in (row := self.slots[at]):
                row[row.index(0)] = mark
                return True
        return False

    def _grow(self) -> None:
        kept = [item for bucket in self.store if bucket for item in bucket.items()]
        buckets = (self.mask + 1) * 2
        while True:
            self._reset(buckets)
            self.resizes += 1
            for key, value in kept:
                mark, one, two = self._place(key)
                if not self._put(mark, one, two):
                    break
                if self.store[one] is None:
                    self.store[one] = {}
                self.store[one][key] = value
            else:
                return
            buckets *= 2

    def get(self, key: bytes):
        """The key's value, or None."""
        mark, one, two = self._place(key)
        if mark not in self.slots[one] and mark not in self.slots[two]:
            return None
        self.verified += 1
        bucket = self.store[one]
        return None if bucket is None else bucket.get(key)

    def set(self, key: bytes, value) -> None:
        mark, one, two = self._place(key)
        if self.get(key) is None:
            while not self._put(mark, one, two):
                self._grow()  # the fingerprint that was moved out last is among the stored keys
                mark, one, two = self._place(key)
            self.size += 1
        if self.store[one] is None:
            self.store[one] = {}
        self.store[one][key] = value

    def delete(self, key: bytes) -> bool:
        if self.get(key) is None:
            return False
        mark, one, two = self._place(key)
        del self.store[one][key]
        row = self.slots[one] if mark in self.slots[one] else self.slots[two]
        row[row.index(mark)] = 0
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (item for bucket in self.store if bucket for item in bucket.items())


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for key, low, n in zip(batch.column("digest").to_pylist(), batch.column("low").to_pylist(), batch.column("n").to_pylist()):
            had = index.get(key)
            if had is not None:
                low, n = had[0] if low is None else low if had[0] is None else min(low, had[0]), n + had[1]
            index.set(key, (low, n))
    rows = list(index.items())
    for i in range(0, len(rows), 20_000):
        part = rows[i : i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
            names=["digest", "low", "n"],
        )


_FOLDED = "digest binary, low long, n long"


def group_digests(digests: DataFrame, index_rows: int = 500_000) -> DataFrame:
    """(digest, low, n) of (digest, id): smallest id and number of rows of every digest. Null ids count as rows and sort last.

    Each input partition folds its own copies; then shards of the digest space, so many that one gets about index_rows of
    the rows at most, whatever the session's number of shuffle partitions: that bounds an index.
    """
    own = digests.select("digest", F.col("id").alias("low"), F.lit(1).cast("long").alias("n")).mapInArrow(_fold, _FOLDED)
    shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // index_rows))
    return own.repartition(shards, "digest").mapInArrow(_fold, _FOLDED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: struct `row` of the columns carry (all, by default), keep_id, group_size, kept, text_sha256.

    Null text is the empty text. The row with the smallest id stays; rows that repeat that id and text are told apart by
    nothing, so all of them say kept, and `keep_rows` thins them to one. If all ids of a group are null, keep_id is null
    and all its rows are kept. An empty table gives an empty result. Other columns, whatever their names, pass through.
    Digests are SHA-256, which stand for the texts that they are taken from. If the text isn't carried, rows are written
    with their digests and read twice; else the digests are taken twice, which is less than writing the texts. The digest
    join moves only the carried columns; groups of one aren't joined, and Spark may split a group's rows.
    """
    names = docs.columns if carry is None else carry
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_col}`").alias("me"),
        F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest"),
    )
    rows = rows if text_col in names else stored(rows)
    groups = group_digests(rows.select("digest", F.col("me").alias("id"))).where("n > 1")
    out = rows.join(groups, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("me")).otherwise(F.col("low"))
    return out.select("row", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("me")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; of rows that repeat id and text one stays."""
    kept = exact_dedup(docs, id_col, text_col).where("kept")
    once = kept.where("group_size = 1").select("row.*")
    more = kept.where("group_size > 1").dropDuplicates(["keep_id", "text_sha256"])
    return once.unionByName(more.select("row.*"))


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame, shards: int = 64) -> DataFrame:
    """The index (digest binary, live long) after inserts and deletes, both with a column digest (binary).

    Copies of a digest are counted before they move. Deleting more copies than are live, or a digest that isn't there,
    leaves none; a digest without live copies leaves the index. Rows with a null digest are ignored.
    """
    moves = inserts.select("digest", F.lit(1).cast("long").alias("d")).unionByName(deletes.select("digest", F.lit(-1).cast("long").alias("d")))
    moves = moves.where("digest is not null").groupBy("digest").agg(F.sum("d").alias("d"))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    old, new = index.select("digest", F.col("live").alias("d"), shard).groupBy("shard"), moves.select("digest", "d", shard).groupBy("shard")

    def change(a: pa.Table, b: pa.Table) -> pa.Table:
        live = CuckooIndex()
        for key, n in zip(a.column("digest").to_pylist(), a.column("d").to_pylist()):
            live.set(key, n)
        for key, n in zip(b.column("digest").to_pylist(), b.column("d").to_pylist()):
            n += live.get(key) or 0
            if n > 0:
                live.set(key, n)
            else:
                live.delete(key)
        rows = list(live.items())
        return pa.table({"digest": pa.array([k for k, _ in rows], pa.binary()), "live": pa.array([v for _, v in rows], pa.int64())})

    return old.cogroup(new).applyInArrow(change, "digest binary, live long")
