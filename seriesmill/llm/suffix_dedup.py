"""Repeated-substring dedup by distributed suffix sorting (operator 1).

Bytes that lie in a string of `length` bytes which also starts elsewhere are found in these steps; documents are dealt
into blocks by a hash, and each step reads the same dealt documents.

1. Sampled suffixes. Every window of `length` bytes picks its smallest 64-byte gram as anchor, so equal windows pick
   equal anchors at equal places. The windows of one anchor span a short stretch of text: the suffix that starts with
   the gram, and what stands before it.
2. A filter. Blocks send the hash of each gram to buckets, once, with its count, and get one byte for each back. A gram
   that is unique in the corpus has windows that are unique too; a false alarm by equal hashes costs work only.
3. The suffixes of all other grams are exchanged: every block sorts its own, sends equal stretches once, and sends
   front-coded runs, which loser trees merge. A comparison starts behind the prefix that both sides are known to share
   with the last output, so known prefixes are never compared again.
4. The merged order decides. A window with b bytes before the gram is repeated if another stretch shares length - b
   bytes from the gram on, which are neighbours by their common prefixes in the merged order, and b bytes before it,
   which are neighbours in the order of what stands before, read backwards. Both are comparisons of bytes, not hashes.
   The windows of a gram that occurs more than `hot` times don't meet in one task: they are spread over all buckets and
   counted by their hashes of 64 bits.
5. The covered stretches return to their blocks and are cut out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import U, blocks_for, chunks, flat, gram_hashes, mix, window_min

GRAM = 64
_LOW = U(0xFFFFFFFF)
SENT, HOT = 1, 2
#: Kinds of rows: spans of a block; a run for a bucket; hashes of hot windows; where a block's stretches lie; a bucket's answer about them.
SPANS, RUN, WINDOWS, PLACES, FOUND = range(5)
_ROWS = "kind int, block int, bucket int, blob binary"


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """For each anchor: row, first and last window (starts in data), place, hash of its gram."""
    names, parts = ("row", "lo", "hi", "pos", "h"), []
    for i, j in chunks(off, 1 << 19):
        base, own = off[i], off[i : j + 1] - off[i]
        part = data[base : base + own[-1]]
        if len(part) < length:
            continue
        g = gram_hashes(part, GRAM)
        a = (window_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1) & _LOW).astype(np.int64)
        good = np.ones(len(a), bool)
        for e in own[1:-1]:
            good[max(0, e - length + 1) : e] = False
        same = np.zeros(len(a) + 1, bool)
        same[1:-1] = good[1:] & good[:-1] & (a[1:] == a[:-1])
        lo, hi = np.flatnonzero(good & ~same[:-1]), np.flatnonzero(good & ~same[1:])
        if len(lo):
            parts.append((np.searchsorted(own, lo, "right") - 1 + i, lo + base, hi + base, a[lo] + base, g[a[lo]]))
    if not parts:
        return {n: np.zeros(0, np.uint64 if n == "h" else np.int64) for n in names}
    return {n: np.concatenate(x) for n, x in zip(names, zip(*parts))}


def grams_by_bucket(found: dict, buckets: int):
    """The different grams of a block, ordered by bucket: their numbers by anchor, and hash and count of each."""
    order = np.lexsort((found["h"], found["h"] % U(buckets)))
    h = found["h"][order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return number, h[at], np.diff(np.append(at, len(h)))


def _sorted_block(t: pa.Table) -> pa.Table:
    """The block's rows in an order that doesn't depend on how they came."""
    return t.sort_by([("id", "ascending"), ("text", "ascending")])


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table({n: pa.array(c, k) for (n, k), c in zip((("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())), cols)})


def judge(h: np.ndarray, n: np.ndarray, hot: int) -> np.ndarray:
    """One byte for each gram that a bucket has got from a block: SENT if it occurs twice or more in all, HOT as well if more than hot times."""
    _, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, weights=n)[back] if len(h) else np.zeros(0)
    return ((total >= 2) * SENT + (total > hot) * HOT).astype(np.uint8)


# ---------------------------------------------------------------- runs and their merge


def pack_run(items: list[tuple[bytes, bytes, int]]) -> bytes:
    """A front-coded run of sorted stretches: (suffix, what stands before it, asked)."""
    head, body, last = np.zeros((len(items), 4), "<u4"), [], b""
    for k, (suffix, before, asked) in enumerate(items):
        same = common(last, suffix, 0)
        head[k] = (same, len(suffix) - same, len(before), asked)
        body += [suffix[same:], before]
        last = suffix
    z = zlib.compress(head.T.tobytes(), 1)
    return len(items).to_bytes(4, "little") + len(z).to_bytes(4, "little") + z + b"".join(body)


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, which agree before start."""
    n, i = min(len(a), len(b)), start
    while i + 16 <= n and a[i : i + 16] == b[i : i + 16]:
        i += 16
    while i < n and a[i] == b[i]:
        i += 1
    return i


class Run:
    """Reads a front-coded run: suffix is the head, lcp its common prefix with the head before."""

    def __init__(self, blob: bytes, block: int):
        n, z = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
        self.head = np.frombuffer(zlib.decompress(blob[8 : 8 + z]), "<u4").reshape(4, n).T.tolist()
        self.body, self.at, self.k, self.suffix, self.block = blob, 8 + z, -1, b"", block
        self.lcp = 0

    def step(self) -> bool:
        self.k += 1
        if self.k >= len(self.head):
            return False
        same, more, left, self.asked = self.head[self.k]
        self.suffix = self.suffix[:same] + self.body[self.at : self.at + more]
        self.at += more
        self.before = self.body[self.at : self.at + left]
        self.at += left
        self.lcp = same
        return True


def merge_runs(runs: list[Run]):
    """Yields (run, lcp) in suffix order, lcp with the suffix before: a loser tree over the runs' heads.

    Every loser keeps the length of the prefix that it shares with the suffix it lost to. Of two heads the one that
    shares more with the last output is smaller; only heads that share equally much are compared, from there on.
    """
    runs = [r for r in runs if r.step()]
    if not runs:
        return
    size = 1 << (len(runs) - 1).bit_length()
    live: list[Run | None] = [*runs, *[None] * (size - len(runs))]
    tree: list[int] = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's lcp becomes that with the winner."""
        x, y = live[a], live[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        n = common(x.suffix, y.suffix, x.lcp)
        if x.suffix[n : n + 1] < y.suffix[n : n + 1] or (n == len(x.suffix) == len(y.suffix) and a < b):
            y.lcp = n
            return a, b
        x.lcp = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, tree[node] = play(build(2 * node), build(2 * node + 1))
        return win

    for r in runs:
        r.lcp = 0
    win = build(1) if size > 1 else 0
    while live[win] is not None:
        run = live[win]
        yield run, run.lcp
        if not run.step():
            live[win] = None
        node = (win + size) >> 1
        while node:
            win, tree[node] = play(win, tree[node])
            node >>= 1


def repeated_windows(runs: list[Run], length: int) -> dict[int, np.ndarray]:
    """Merges runs; by block what is repeated of its stretches that were asked for, in rows (number in the run, start, end)."""
    suffixes, befores, meta = [], [], []
    for run, lcp in merge_runs(runs):
        suffixes.append(len(run.suffix))
        befores.append(run.before)
        meta.append((run.block, run.k, run.asked, lcp))
    if not meta:
        return {}
    block, number, asked, lcp = np.array(meta, np.int64).T
    right, left, n = np.array(suffixes), np.array([len(x) for x in befores]), len(meta)
    backwards = [x[::-1] for x in befores]
    order = np.array(sorted(range(n), key=backwards.__getitem__))
    # the common prefixes of neighbours in the order of what stands before, read backwards
    size = left[order]
    width = int(left.max())
    text = np.zeros((n, width), np.uint8)
    inside = np.arange(width) < size[:, None]
    text[inside] = np.frombuffer(b"".join([backwards[k] for k in order]), np.uint8)
    back_lcp = np.zeros(n, np.int64)
    if n > 1 and width:
        differ = (text[1:] != text[:-1]) | ~inside[1:] | ~inside[:-1]
        back_lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    hits = np.zeros((n, width + 3), np.int8)  # column b + 1: the window with b bytes before the gram
    place = np.empty(n, np.int64)
    for b in range(width + 1):
        group = np.cumsum(lcp < length - b)
        able = np.flatnonzero((left >= b) & (right >= length - b))
        able = able[np.bincount(group[able], minlength=n + 1)[group[able]] > 1]
        if not len(able):
            continue
        place[order] = np.cumsum(back_lcp < b)
        key = group[able] * (n + 1) + place[able]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] = same
        twice[:-1] |= same
        hits[able[by[twice]], b + 1] = 1
    hits[asked == 0] = 0
    change = np.diff(hits, axis=1)
    item, first = np.nonzero(change == 1)
    _, stop = np.nonzero(change == -1)
    rows = np.stack([number[item], left[item] - stop + 1, left[item] - first + length], 1)  # windows with b from first to stop - 1
    whose = block[item]
    return {int(k): rows[whose == k] for k in np.unique(whose)}


def _spans_blob(rows: np.ndarray) -> bytes:
    return zlib.compress(rows.astype("<i8").T.tobytes(), 1)


def _spans(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<i8").reshape(3, -1).T


# ---------------------------------------------------------------- the operator


def covered(data: np.ndarray, off: np.ndarray, spans: list[np.ndarray]) -> np.ndarray:
    """Which bytes of the block's rows lie in one of the spans (row, start, end), given by offsets into data."""
    change = np.zeros(len(data) + 1, np.int32)
    for s in spans:
        np.add.at(change, s[:, 1], 1)
        np.add.at(change, s[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def suffix_array_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = True, block_bytes: int = 4 << 20, hot: int = 100_000) -> DataFrame:
    """One row for each row of docs: struct `row` of the columns carry (all but the text, by default), n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked.

    A byte is removed if it lies in a string of `length` bytes (at least 64) that also starts anywhere else, in the same
    row or another; all strings are judged on the input. kept_text leaves characters whole: one of which only a part is
    repeated stays. Null text is empty, texts shorter than `length` stay as they are, rows that repeat are copies of
    each other (and lose all they have in common), an empty table gives an empty result, other columns pass through.
    A task holds one block of documents, or one bucket of hashes or runs; a row is held whole.
    """
    names = [c for c in docs.columns if c != text_col] if carry is None else carry
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blocks = blocks_for(docs, f"`{text_col}`", block_bytes)
    one = F.lit(1).alias("_")
    row = F.struct(*[F.col(f"`{c}`") for c in names], *([] if names else [one])).alias("row")
    dealt = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(blocks)).cast("int").alias("block"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), row)

    def number_of(t: pa.Table) -> int:
        return t.column("block")[0].as_py()

    def send_hashes(t: pa.Table) -> pa.Table:
        t = _sorted_block(t)
        _, h, n = grams_by_bucket(anchors(*flat(t.column("text")), length), blocks)
        where = (h % U(blocks)).astype(np.int64)
        cut = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
        return _table([(0, number_of(t), int(where[a]), h[a:b].tobytes() + n[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])])

    def answer(t: pa.Table) -> pa.Table:
        parts = [(block, len(x) // 12, x) for block, x in zip(t.column("block").to_pylist(), t.column("blob").to_pylist())]
        h = np.concatenate([np.frombuffer(x, np.uint64, n) for _, n, x in parts])
        state = judge(h, np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for _, n, x in parts]), hot)
        bucket, rows, at = t.column("bucket")[0].as_py(), [], 0
        for block, n, _ in parts:
            own, at = state[at : at + n], at + n
            if own.any():
                rows.append((0, block, bucket, own.tobytes()))
        return _table(rows)

    def send_runs(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _table([])
        t = _sorted_block(t)
        block, (data, off) = number_of(t), flat(t.column("text"))
        found = anchors(data, off, length)
        number, h, _ = grams_by_bucket(found, blocks)
        where = (h % U(blocks)).astype(np.int64)
        first = np.searchsorted(where, np.arange(blocks + 1))
        state = np.zeros(len(h), np.uint8)
        for bucket, x in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()):
            state[first[bucket] : first[bucket + 1]] = np.frombuffer(x, np.uint8)
        own = state[number]
        rows, raw = [], data.tobytes()
        runs: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
        sent = np.flatnonzero((own & (SENT | HOT)) == SENT)
        for k, bucket, lo, pos, end in zip(sent.tolist(), where[number[sent]].tolist(), found["lo"][sent].tolist(), found["pos"][sent].tolist(), (found["hi"][sent] + length).tolist()):
            runs.setdefault(bucket, {}).setdefault((raw[pos:end], raw[lo:pos]), []).append(k)
        for bucket, items in runs.items():
            items = sorted(items.items())  # equal stretches are one; if there are two of it, all its windows are repeated
            rows.append((RUN, block, bucket, pack_run([(*x, int(len(at) == 1)) for x, at in items])))
            once = np.array([(k, at[0]) for k, (_, at) in enumerate(items) if len(at) == 1], np.int64).reshape(-1, 2)
            twice = np.array([k for _, at in items if len(at) > 1 for k in at], np.int64)
            if len(once):
                rows.append((PLACES, block, block, bucket.to_bytes(4, "little") + _spans_blob(np.stack([once[:, 0], found["row"][once[:, 1]], found["lo"][once[:, 1]]], 1))))
            if len(twice):
                rows.append((SPANS, block, block, _spans_blob(np.stack([found["row"][twice], found["lo"][twice], found["hi"][twice] + length], 1))))
        many = np.flatnonzero(own & HOT)
        if len(many):
            lo, n = found["lo"][many], found["hi"][many] - found["lo"][many] + 1
            item = np.repeat(np.arange(len(many)), n)
            at = lo[item] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            key = np.concatenate([gram_hashes(data[a : a + c + length - 1], length) for a, c in zip(lo, n)])
            key = mix(key + found["h"][many][item])
            order = np.lexsort((at, key, key % U(blocks)))
            key, at, own_row = key[order], at[order], found["row"][many][item][order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            count = np.bincount(np.cumsum(new) - 1)
            twice = (count >= 2)[np.cumsum(new) - 1]
            if twice.any():
                rows.append((SPANS, block, block, _spans_blob(np.stack([own_row[twice], at[twice], at[twice] + length], 1))))
            key, at, own_row, ask = (x[new] for x in (key, at, own_row, ~twice))
            to = (key % U(blocks)).astype(np.int64)
            cut = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
            for a, b in zip(cut[:-1], cut[1:]):
                rows.append((WINDOWS, block, int(to[a]), zlib.compress(np.stack([key[a:b].view(np.int64), own_row[a:b], at[a:b], ask[a:b]]).astype("<i8").tobytes(), 1)))
        return _table(rows)

    def merge(t: pa.Table) -> pa.Table:
        rows, runs, many = [], [], []
        bucket = t.column("bucket")[0].as_py()
        for kind, block, blob in zip(t.column("kind").to_pylist(), t.column("block").to_pylist(), t.column("blob").to_pylist()):
            if kind == RUN:
                runs.append(Run(blob, block))
            elif kind == WINDOWS:
                x = np.frombuffer(zlib.decompress(blob), "<i8").reshape(4, -1)
                many.append(np.concatenate([x, np.full((1, x.shape[1]), block)]))
            else:
                rows.append((kind, block, 0, blob))
        runs.sort(key=lambda r: r.block)
        for block, part in repeated_windows(runs, length).items():
            rows.append((FOUND, block, 0, bucket.to_bytes(4, "little") + _spans_blob(part)))
        if many:
            key, own_row, at, ask, whose = np.concatenate(many, 1)
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = (count[back] >= 2) & (ask == 1)
            for block in np.unique(whose[hit]):
                k = hit & (whose == block)
                rows.append((SPANS, int(block), 0, _spans_blob(np.stack([own_row[k], at[k], at[k] + length], 1))))
        return _table(rows)

    def spans_of(table: pa.Table) -> list[np.ndarray]:
        """Spans of a block, those given directly and those of its stretches in the buckets' answers."""
        out, places, found = [], {}, {}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == SPANS:
                out.append(_spans(blob))
            else:
                (places if kind == PLACES else found)[int.from_bytes(blob[:4], "little")] = _spans(blob[4:])
        for bucket, x in found.items():
            own = places[bucket]
            at = np.searchsorted(own[:, 0], x[:, 0])
            out.append(np.stack([own[at, 1], own[at, 2] + x[:, 1], own[at, 2] + x[:, 2]], 1))
        return out

    def cut_out(t: pa.Table, spans: pa.Table) -> pa.Table:
        t = _sorted_block(t) if t.num_rows else t
        data, off = flat(t.column("text"))
        gone = covered(data, off, spans_of(spans))
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        starts[off[:-1][off[:-1] < len(data)]] = gone[off[:-1][off[:-1] < len(data)]]
        sums, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts))
        digest, kept = [], []
        for a, b, n in zip(off[:-1], off[1:], np.diff(sums[off])):
            part = data[a:b]
            digest.append(hashlib.sha256((part[~gone[a:b]] if n else part).tobytes()).hexdigest())
            if keep_text:
                kept.append(whole_characters(part, gone[a:b]) if n else part.tobytes().decode("utf-8", "replace"))
        cols = {"row": t.column("row"), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(np.diff(sums[off]), pa.int64()), "n_spans": pa.array(np.diff(runs[off]), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(kept, pa.string())} if keep_text else {}))

    hashes = dealt.groupBy("block").applyInArrow(send_hashes, _ROWS)
    answers = hashes.groupBy("bucket").applyInArrow(answer, _ROWS)
    runs = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send_runs, _ROWS)
    spans = runs.groupBy("bucket").applyInArrow(merge, _ROWS)
    schema = f"row {dealt.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut_out, schema)


def whole_characters(part: np.ndarray, gone: np.ndarray) -> str:
    """What stays of a text if a character goes only when all its bytes go."""
    lead = (part & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    goes = np.bincount(char, weights=~gone) == 0
    return part[~goes[char]].tobytes().decode("utf-8", "replace")
