"""Line dedup by pairwise alignment (operator 9).

A line goes if any earlier document's alignment with its own document deletes it. Documents that may be paired are found
through hashes of shared lines, rare ones first: a line that at most `rare` earlier documents hold leads to all of them.
Each pair is aligned by patience diff, and the aligned common blocks are deleted from the later document; blocks are
judged on the input.

Not all pairs need aligning for the result of all. Lines of one document only count alike in any alignment with others,
so documents that are equal but for them (of the same form) do the same to a later document, and the first stands for
all. What the rare lines' partners leave of frequent lines is tried exactly as well: with the documents that hold them,
from the nearest backwards, in rounds that grow eightfold, until all that is shared is deleted or no partner is left.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import discard, stored


def line_hash(line: str) -> int:
    """64 bits of the line without white space at its ends; 0 for an empty one."""
    line = line.strip()
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if line else 0


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines in order: unique lines of both anchor, what surrounds them is matched outwards, gaps anew."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        common = sorted((once_a[x], once_b[x]) for x in once_a.keys() & once_b.keys())
        tops: list[int] = []  # the piles' top places in b
        heads: list[int] = []
        back = [-1] * len(common)
        for k, (_, j) in enumerate(common):
            p = bisect.bisect_left(tops, j)
            back[k] = heads[p - 1] if p else -1
            if p == len(tops):
                tops.append(j)
                heads.append(k)
            else:
                tops[p], heads[p] = j, k
        chain, k = [], heads[-1] if heads else -1
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        i, j = a0, b0
        for x, y in chain:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, a1, j, b1))
    return sorted(out)


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    at: dict[int, int] = {}
    for k in range(lo, hi):
        at[x[k]] = -1 if x[k] in at else k
    return {h: k for h, k in at.items() if k >= 0 and h}


def common_blocks(a: list[int], b: list[int], words_b: list[int], least_words: int) -> list[int]:
    """Places in b that lie in an aligned block of at least least_words words. A block is a run of neighbours in both."""
    out: list[int] = []
    run: list[int] = []
    last = None
    for i, j in [*patience(a, b), (None, None)]:
        if last is None or i is None or (i, j) != (last[0] + 1, last[1] + 1):
            if run and sum(words_b[k] for k in run) >= least_words:
                out += run
            run = []
        if i is None:
            break
        run.append(j)
        last = (i, j)
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and sizes of all lines of a batch of documents, and where each document begins (one more than documents)."""
    lines, sizes = batch.column("lines"), batch.column("sizes")
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    return lines.flatten().to_numpy(zero_copy_only=False), sizes.flatten().to_numpy(zero_copy_only=False), first


def runs(lines: np.ndarray, sizes: np.ndarray, first: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of runs of neighbouring lines, by start: from and up to each line the shortest of at least least_words words.

    Every block of so many words is covered by the runs inside it, and documents that share the block share their hashes.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    k, words = np.arange(len(lines)), np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    ends = np.maximum(np.searchsorted(words, words[:-1] + least_words, "left"), k + 1)
    starts = np.minimum(np.searchsorted(words, words[1:] - least_words, "right") - 1, k)
    down, up = ends <= first[doc + 1], starts >= first[doc]
    span = np.unique(np.concatenate([np.stack([k[down], ends[down]], 1), np.stack([starts[up], k[up] + 1], 1)]), axis=0)
    start, end = span[:, 0], span[:, 1]
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.cumprod(np.full(len(lines) + 1, np.uint64(pow(int(base), -1, 1 << 64)))) * base
    ahead = np.cumprod(np.full(len(lines) + 1, base)) * np.uint64(pow(int(base), -1, 1 << 64))
    value = lines.astype(np.int64).view(np.uint64) + np.uint64(0xD1B54A32D192ED03)  # empty lines count too
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * back[:-1])])
    h = ((total[end] - total[start]) * ahead[start]).view(np.int64)
    one = end - start == 1
    h[one] = lines[start[one]]
    return h, start, end


#: Quantiles of the ids that stand in a plan as literals; beyond them pieces are even parts of what lies between two.
EDGES = 1024


def _pieces(docs: DataFrame, ident: Column, chunk: int) -> Column:
    """The number of the stretch of ids that ident lies in, ascending with the ids: about chunk of docs (i) in each."""
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("i"), F.max("i")).first()
    pieces = -(-n // chunk)
    if pieces <= 1:
        return F.lit(0)
    most = min(EDGES, pieces)
    edges = sorted({int(e) for e in docs.approxQuantile("i", [k / most for k in range(1, most)], 0.25 / most)})
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= ident)) if edges else F.lit(0)
    parts = -(-pieces // most)
    if parts == 1:
        return at
    bound = lambda k: F.element_at(F.array(*[F.lit(float(e)) for e in (low, *edges, high + 1)]), at + k)
    share = (ident.cast("double") - bound(1)) / F.greatest(F.lit(1.0), bound(2) - bound(1))
    return at * parts + F.least(F.lit(parts - 1), F.floor(share * parts)).cast("int")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, chunk: int = 4096, rare: int = 4, keep_text: bool = True) -> DataFrame:
    """id, n_lines, n_removed, partners, kept_sha256, and kept_text if asked: one row for each row of docs.

    Lines end at \\n and are equal if equal without white space at their ends. "Earlier" is by id, and by the text's hash
    between rows that repeat an id; rows that repeat both are one document, and all of them get the same result. Lines
    of fewer than least_words words lead to a pair, and go, only as part of a block with so many words. Null text is
    empty and has one empty line; null ids come first; an empty table gives an empty result; other columns stay out.
    partners counts the alignments made. A line's documents are never gathered: within chunks of ids they are numbered
    by a window, across chunks from one row for each line and chunk.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    key = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("i"), F.xxhash64("text").alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lines = [t.split("\n") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array([[line_hash(x) for x in own] for own in lines], pa.list_(pa.int64())), pa.array([[len(x.split()) for x in own] for own in lines], pa.list_(pa.int32()))], names=["i", "t", "lines", "sizes"])

    keyed = rows.select(key.alias("k"), "text").select(F.col("k.i").alias("id"), F.col("k.t").alias("t"), "text")
    split_up = stored(keyed.mapInArrow(split, "i long, t long, lines array<long>, sizes array<int>").dropDuplicates(["i", "t"]))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes, first = _arrays(batch)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            h, start, _ = runs(lines, sizes, first, least_words)
            leads = np.concatenate([np.ones(len(h), bool), np.zeros(len(lines), bool)])
            h, doc = np.concatenate([h, lines]), np.concatenate([doc[start], doc])
            order = np.lexsort((~leads, h, doc))
            h, doc, leads = h[order], doc[order], leads[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            new &= h != 0
            at = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), batch.column("i").take(at), batch.column("t").take(at), pa.array(leads[new])], names=["h", "i", "t", "leads"])

    has = split_up.mapInArrow(units, "h long, i long, t long, leads boolean").select("h", F.struct("i", "t").alias("d"), "leads")
    df = stored(has.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))  # a table, so that Spark can split the rows of a frequent line in the join
    piece = _pieces(split_up, F.col("d.i"), chunk)
    shared = stored(has.join(df, "h").select("h", "d", "leads"))
    text_of = split_up.select(F.struct("i", "t").alias("d"), "lines", "sizes")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, whole = [], []
            for lines, own in zip(batch.column("lines").to_pylist(), batch.column("own").to_pylist()):
                own = {0, *own}
                left = [x if x in own else None for x in lines]
                kept = [x for k, x in enumerate(left) if x is not None or not k or left[k - 1] is not None]
                out.append(hashlib.blake2b(repr(kept).encode(), digest_size=16).digest())
                whole.append(None not in kept)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(out, pa.binary()), pa.array(whole), pa.array([sum(x) for x in batch.column("sizes").to_pylist()], pa.int64())], names=["d", "form", "whole", "words"])

    own = shared.groupBy("d").agg(F.collect_list("h").alias("own"), F.max("leads").alias("leads")).where("leads").select("d", "own")
    forms = stored(text_of.join(own, "d").mapInArrow(form, "d struct<i:long,t:long>, form binary, whole boolean, words long"))
    firsts = forms.groupBy("form").agg(F.min("d").alias("d")).select("d", F.lit(1).alias("first"))
    forms = stored(forms.drop("form").join(firsts, "d", "left").withColumn("first", F.coalesce("first", F.lit(0))))
    copies = forms.where("whole and first = 0")  # the first of the form is the same text but for white space
    from pyspark.sql import Window

    leads = stored(shared.where("leads").join(forms, "d").withColumn("piece", piece).select("h", "d", "first", "piece", (F.col("whole") & (F.col("first") == 0)).alias("copy")))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = leads.groupBy("h", "piece").agg(F.sum("first").alias("top"))
    tops = tops.withColumn("outer", F.coalesce(F.sum("top").over(before("h").orderBy("piece")), F.lit(0))).drop("top")
    inner = leads.withColumn("inner", F.coalesce(F.sum("first").over(before("h", "piece").orderBy("d")), F.lit(0)))
    placed = stored(inner.join(tops, ["h", "piece"]).select("h", "d", "first", "copy", (F.col("inner") + F.col("outer")).alias("r")))  # r: firsts before d
    holders = placed.where("first = 1").select("h", F.col("r").alias("place"), F.col("d").alias("earlier"))
    todo = placed.where("r > 0 and not copy").groupBy("d").agg(F.collect_list(F.struct("h", "r")).alias("todo"))
    early = text_of.select(F.col("d").alias("earlier"), F.col("lines").alias("early_lines"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(a, b, w, least_words) for a, b, w in zip(*(batch.column(c).to_pylist() for c in ("early_lines", "lines", "sizes")))]
            yield pa.RecordBatch.from_arrays([batch.column("later"), pa.array(gone, pa.list_(pa.int32()))], names=["later", "gone"])

    def rest(tried: int):
        """What is still to do after the nearest `tried` partners of frequent lines: hashes of runs that aren't deleted as a whole."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines, sizes, first = _arrays(batch)
                h, start, end = runs(lines, sizes, first, least_words)
                left, dead = [], []
                at = np.searchsorted(start, first)
                for k, (todo, new, old) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("todo", "gone", "dead")))):
                    both = sorted({*(new or ()), *(old or ())})
                    open_ = np.ones(first[k + 1] - first[k] + 1, np.int64)
                    open_[both] = 0
                    total = np.concatenate([[0], np.cumsum(open_)])
                    a, b = slice(at[k], at[k + 1]), first[k]
                    some = set(h[a][total[end[a] - b] > total[start[a] - b]].tolist())
                    left.append([x for x in todo if x["r"] > max(tried, rare) and x["h"] in some])
                    dead.append(both)
                keep = pa.array([k for k, x in enumerate(left) if x], pa.int64())
                cols = [batch.column("d"), batch.column("lines"), batch.column("sizes"), pa.array(left, batch.column("todo").type), pa.array(dead, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([x.take(keep) for x in cols], names=["d", "lines", "sizes", "todo", "dead"])

        return run

    state = stored(text_of.join(todo, "d").withColumn("dead", F.array().cast("array<int>")))
    parts = [copies.where(F.col("words") >= least_words).join(text_of, "d").select(F.col("d").alias("later"), F.sequence(F.lit(0), F.size("lines") - 1).alias("gone"), F.lit(1).cast("long").alias("partners"))]
    tried, upto, first = 0, rare, True  # the first round is that of rare lines
    while state.limit(1).count():
        todo = state.select(F.col("d").alias("later"), F.explode("todo").alias("x")).select("later", "x.h", "x.r")
        todo = todo.where(F.col("r") <= rare) if first else todo
        want = todo.select("later", "h", F.explode(F.sequence(F.greatest(F.lit(0), F.col("r") - upto), F.col("r") - 1 - tried)).alias("place"))
        pairs = want.join(holders, ["h", "place"]).select("later", "earlier").distinct()
        both = pairs.join(early, "earlier").join(state.select(F.col("d").alias("later"), "lines", "sizes"), "later").select("later", "early_lines", "lines", "sizes")
        aligned = both.mapInArrow(align, "later struct<i:long,t:long>, gone array<int>")
        lines_gone = aligned.select("later", F.posexplode_outer("gone").alias("p", "line"))  # an alignment without a block has one row, too
        part = stored(lines_gone.groupBy("later").agg(F.collect_set("line").alias("gone"), F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("partners")))
        parts.append(part)
        before_, state = state, stored(state.join(part.select(F.col("later").alias("d"), "gone"), "d", "left").mapInArrow(rest(tried if first else upto), state.schema))
        discard(before_)
        tried, upto, first = (0, 1, False) if first else (upto, upto * 8, False)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    gone = every.groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.sum("partners").alias("partners"))
    out = rows.withColumn("k", key).join(gone, F.col("k") == F.col("later"), "left").select("id", "text", "gone", F.coalesce("partners", F.lit(0).cast("long")).alias("partners"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept = [], [], [], []
            for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                lines, drop = (t or "").split("\n"), set(g or ())
                left = "\n".join([x for k, x in enumerate(lines) if k not in drop])
                total.append(len(lines))
                removed.append(len(drop))
                digest.append(hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
                kept.append(left)
            cols, names = [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column("partners"), pa.array(digest, pa.string())], ["id", "n_lines", "n_removed", "partners", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if keep_text else []), names=names + (["kept_text"] if keep_text else []))

    return out.mapInArrow(cut, "id long, n_lines long, n_removed long, partners long, kept_sha256 string" + (", kept_text string" if keep_text else ""))
