"""Spelling variants (operator 11): words that differ by one inserted, deleted or replaced code point.

A single edit lies in one third of the shorter word, so two such words share what stands before and behind that third.
Words are dealt by that, three keys for the case that a word is the shorter (or equally long) one and three for the
longer one, and sorted in their partition. Blocks of neighbouring words become padded matrices of code points, once
from the left and once from the right; a pair of blocks is compared as a whole, column by column. Common prefix and
suffix together reach the longer length less one exactly for single edits. A pair counts under the key of the third in
which its first difference lies, so it is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import discard, stored

#: Maximal runs of these are words.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_of: int | None = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): words of at least least_length code points that come at least least_n times in all texts.

    Words are runs of letters with A-Z lower-cased. If drop_one_of divides a run's checksum h, the unsigned CRC-32 of
    `<id>:<run>`, its code point h % length goes (that plants misspellings); None leaves all runs as they are. Null texts
    have no words, a null id counts as the empty string. Counts are added up before they are shuffled.
    """
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("word"))
    if drop_one_of:
        runs = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        runs = runs.select(F.when(F.col("h") % drop_one_of == 0, F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


# ---------------------------------------------------------------- keys


def _ends(size: Column) -> list[Column]:
    """Where the thirds of a word of this size begin and end."""
    return [F.lit(0), (size / 3).cast("int"), (size * 2 / 3).cast("int"), size]


def keys(words: DataFrame) -> DataFrame:
    """(key, size, third, word, n): six rows for each word. size: length of the shorter word of a pair; third: where the edit lies."""
    length, rows = F.length("word"), []
    for shorter in (True, False):
        size = length if shorter else length - 1
        ends = _ends(size)
        for k in range(3):
            head, tail = F.substring(F.col("word"), F.lit(1), ends[k]), F.when(ends[k + 1] < size, F.substring(F.col("word"), length - (size - ends[k + 1]) + 1, size)).otherwise("")
            rows.append(F.struct(F.xxhash64(size, F.lit(k), head, tail).alias("key"), size.alias("size"), F.lit(k).alias("third")))
    return words.select(F.explode(F.array(*rows)).alias("k"), "word", "n").select("k.*", "word", "n")


def spread(keyed: DataFrame, tile_rows: int = 4096) -> DataFrame:
    """keyed with the columns one and two, 0 for most. A key of more than tile_rows words is cut into parts by the words' hashes, and
    each pair of its parts becomes a group of its own: one and two are the pair's parts, and words of both have rows there."""
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > tile_rows).select("key", F.ceil(F.col("m") / tile_rows).cast("int").alias("parts")))
    own = keyed.join(hot, "key", "left")
    part = F.pmod(F.xxhash64("word", F.lit(11)), F.col("parts")).cast("int")
    each = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("part")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, part).alias("one"), F.greatest(x, part).alias("two"), part.alias("part")))
    )
    return own.select("key", "size", "third", "word", "n", F.explode(each).alias("p")).select("key", "size", "third", "word", "n", "p.*")


# ---------------------------------------------------------------- tiles


def matrices(points: np.ndarray, off: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded to the longest: from the left, and from the right in reverse. A row for each place, a column for each word."""
    size = np.diff(off)
    place = np.arange(int(size.max(initial=0)))[:, None]
    there = place < size
    left, right = np.full(there.shape, pad, np.uint32), np.full(there.shape, pad, np.uint32)
    left[there] = points[(off[:-1] + place)[there]]
    right[there] = points[(off[1:] - 1 - place)[there]]
    return left, right


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading places each word of a has in common with each of b."""
    out = np.zeros((a.shape[1], b.shape[1]), np.int32)
    alive = np.ones(out.shape, bool)
    for x, y in zip(a, b):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        out += alive
    return out


class Words:
    """Rows of a partition in the order of (size, key, one, two), and the single edits among them."""

    def __init__(self, table: pa.Table, block: int):
        self.words, self.n = table.column("word").to_pylist(), table.column("n").to_numpy()
        self.key, self.size, self.third = (table.column(c).to_numpy() for c in ("key", "size", "third"))
        pair = table.column("one").to_numpy().astype(np.int64) << 32 | table.column("two").to_numpy()
        self.part, self.same = table.column("part").to_numpy(), table.column("one").to_numpy() == table.column("two").to_numpy()
        change = (self.key[1:] != self.key[:-1]) | (self.size[1:] != self.size[:-1]) | (pair[1:] != pair[:-1])
        self.group = np.concatenate([[0], np.cumsum(change)]).astype(np.int32)
        self.length = np.array([len(w) for w in self.words], np.int32)
        self.off = np.concatenate([[0], np.cumsum(self.length)])
        self.points = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.block = block

    def _matrices(self, i: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
        j = min(i + self.block, len(self.words))
        return matrices(self.points[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i], pad)

    def _tile(self, i: int, left, right, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of block i and of block j that are near, each pair once. left, right: block i's matrices."""
        rows, cols = slice(i, i + self.block), slice(j, j + self.block)
        other_left, other_right = self._matrices(j, 1)
        prefix, suffix = common(left, other_left), common(right, other_right)
        a, b = self.length[rows][:, None], self.length[cols][None, :]
        size = self.size[rows][:, None]
        near = (prefix + suffix >= np.maximum(a, b) - 1) & (np.minimum(a, b) == size) & (np.abs(a - b) <= 1) & ((prefix < a) | (prefix < b)) & (self.group[rows][:, None] == self.group[cols][None, :])
        x, y = np.nonzero(near)
        p, s, k, x, y = prefix[x, y], self.size[i + x], self.third[i + x], i + x, j + y
        low, high = np.where(k == 0, 0, np.where(k == 1, s // 3, 2 * s // 3)), np.where(k == 0, s // 3, np.where(k == 1, 2 * s // 3, s + 1))
        good = (p >= low) & (p < high) & (self.third[y] == k) & (self.same[x] | (self.part[x] != self.part[y]))
        if i == j:
            good &= x < y
        return x[good], y[good]

    def edits(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both words of each pair. A block meets itself and the blocks into which its last group goes on."""
        found = []
        for i in range(0, len(self.words), self.block):
            last, j = self.group[min(i + self.block, len(self.words)) - 1], i
            left, right = self._matrices(i, 0)
            while j < len(self.words) and (j == i or self.group[j] == last):
                found.append(self._tile(i, left, right, j))
                j += self.block
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def summary(self) -> pa.RecordBatch:
        """(word, n_near, best): of each word with near ones here their number, and (-n, word) of the best."""
        x, y = self.edits()
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[y], -self.n[y], x))
        x, y = x[order], y[order]
        row, first, count = np.unique(x, return_index=True, return_counts=True)
        best = pa.StructArray.from_arrays([pa.array(-self.n[y[first]]), pa.array([self.words[k] for k in y[first]], pa.string())], names=["less", "word"])
        return pa.RecordBatch.from_arrays([pa.array([self.words[k] for k in row], pa.string()), pa.array(count.astype(np.int64)), best], names=["word", "n_near", "best"])


_NEAR = "word string, n_near long, best struct<less: long, word: string>"


def near_words(words: DataFrame, block: int = 128, tile_rows: int = 4096, chunk_rows: int = 16_384) -> DataFrame:
    """(word, n_near, best): for each word of words (word, n) with near ones their number, and the one with the largest n as (less = -n, word)."""
    placed = spread(stored(keys(words)), tile_rows)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(partitions, "key", "one", "two").sortWithinPartitions("size", "key", "one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk_rows:  # whole groups go; the last one may go on
                table = pa.Table.from_batches(held)
                ids = [table.column(c).to_numpy() for c in ("key", "one", "two", "size")]
                end = int(np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))[-1]) + 1 if any((x != x[-1]).any() for x in ids) else 0
                if end:
                    yield Words(table.slice(0, end), block).summary()
                    held, rows = table.slice(end).combine_chunks().to_batches(), table.num_rows - end
        if rows:
            yield Words(pa.Table.from_batches(held), block).summary()

    return dealt.mapInArrow(compare, _NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


# ---------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the chain of forms that begins at a word ends. Chains double in each round, so there are few rounds."""
    chain = stored(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chain.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(chain)
        chain = longer
        if chain.where("moved").isEmpty():
            return chain.select("word", "root")
        chain = chain.select("word", "root")
        chain.stored_at = longer.stored_at


def spelling_variants(words: DataFrame, ratio: int = 2, block: int = 128, tile_rows: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n); word is unique.

    A word's form is the near word (one code point inserted, deleted or replaced) of largest n, ties to the smallest in
    code-point order, if that n is at least ratio (above 1) times the word's; else form and form_n are null. root follows
    forms to the last one. n_near counts near words. Null words go; an empty table gives an empty result. Keys that many
    words share are cut into parts of about tile_rows words, and pairs of parts are dealt to different tasks. Further
    columns of words are left out.
    """
    if ratio <= 1:
        raise ValueError("with a ratio of 1 or less chains of forms may not end")
    words = words.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    words = stored(words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"))
    found = words.join(near_words(words, block, tile_rows), "word", "left")
    far = -F.col("best.less")
    formed = F.when(far >= ratio * F.col("n"), far)
    rows = stored(found.select("word", F.when(formed.isNotNull(), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("form_n")))
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
