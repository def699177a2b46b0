"""BPE encoding and decoding with a pair occurrence index (operator 5).

The distinct words of a stretch of a partition are encoded together: their symbols lie in one array as linked lists,
an index maps each pair that has a merge to all its positions, and the active ranks are applied in ascending order;
a merge updates the lists of the pairs that it takes part in. Words don't touch each other, so a wave over the index
applies to every word its lowest active rank, leftmost first, on whole arrays; very long words, which would need many waves, have an
index and a heap of active ranks of their own. Texts are then put together from the words' ids, and decoded from these.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seriesmill.llm.common import U, _powers, mix

SPACE, LETTER, NUMBER, OTHER = range(4)
_CONTRACTION = regex.compile("'(?:s|t|re|ve|m|ll|d)")

#: White space as the tokenizer's normaliser takes it (Unicode's White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Words as the tokenizer splits them; what lies between them is dropped.
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return [out[b] for b in range(256)]


class BpeCodec:
    """The vocabulary of a tokenizers file of the word-end kind: NFC, white space, lower case, split, byte-level BPE."""

    def __init__(self, path: str, most_words: int = 300_000):
        """most_words: distinct words to keep; beyond that they are forgotten and encoded anew when they return."""
        spec = json.load(open(path, encoding="utf-8"))
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.name = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.has = np.zeros(max(self.name) + 1, bool)
        self.has[list(self.name)] = True
        self.word = regex.compile(_WORD)
        alphabet = _byte_alphabet()
        self.inner, self.last = [vocab[c] for c in alphabet], [vocab[c + end] for c in alphabet]
        self.merges: dict[int, tuple[int, int]] = {}  # left << 20 | right: rank and result
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        pairs = np.array(list(self.merges), np.int64)
        order = np.argsort(pairs)
        self.pair = pairs[order]
        self.rank, self.made = (np.array([x[k] for x in self.merges.values()], np.int64)[order] for k in (0, 1))
        self.made_by_rank = np.zeros(int(self.rank.max(initial=-1)) + 1, np.int64)
        self.made_by_rank[self.rank] = self.made
        self.bytes = np.array([self.inner, self.last], np.int64)
        self.most_words = most_words
        every = "".join(map(chr, range(0x110000)))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{_SPACE}]+")):
            for m in regex.finditer(pattern, every):
                self.kind[m.start() : m.end()] = kind
        self.kind[0] = SPACE  # stands between texts; one that holds it takes another path
        self.mark, self.check = np.random.default_rng(3).integers(0, 2**63, (2, 0x110000), dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        self.slot = np.full(1 << 21, -1, np.int32)  # open addressing: word numbers by hash
        self.key, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # a word is known by two hashes of 64 bits
        self.pool, self.first = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # the ids of all words, and where each word's begin

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand as they are, with a leading NUL to tell them from words."""
        if self.cut and "<|" in text:
            out = []
            for part in self.cut.split(text):
                out += ["\0" + part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower case without a look at the neighbours
        return self.word.findall(text.lower())

    def cut_words(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and two hashes of the words of a lower-cased text, by the same rule as the pattern, on whole arrays."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[code]
        begin = np.empty(len(code) + 1, bool)
        begin[0], begin[-1] = True, True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:-1])
        begin[:-1] |= kind == NUMBER
        quote = np.flatnonzero((code == 39) & begin[:-1])
        for q in quote.tolist():  # a word that starts with an apostrophe may be a contraction
            m = _CONTRACTION.match(joined, q)
            if m:
                begin[q + 1 : m.end()] = False
                begin[m.end()] = True
        at = np.flatnonzero(begin)
        start, end = at[:-1], at[1:]
        word = kind[start] != SPACE
        start, end = start[word], end[word]
        up, down = _powers(len(code) + 1)
        out = []
        for mark in (self.mark, self.check):
            sums = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(mark[code] * down[:-1], out=sums[1:])
            out.append(mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64)))
        return start, end, out[0], out[1]

    def find(self, h: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those that aren't known."""
        out, todo, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & U(len(self.slot) - 1)).astype(np.int64)
        while len(todo):
            w = self.slot[slot]
            full = w >= 0
            hit = full.copy()
            hit[full] = (self.key[w[full]] == h[todo[full]]) & (self.second[w[full]] == second[todo[full]])
            out[todo[hit]] = w[hit]
            more = full & ~hit
            todo, slot = todo[more], (slot[more] + 1) & (len(self.slot) - 1)
        return out

    def number(self, h: np.ndarray, second: np.ndarray, spell) -> np.ndarray:
        """The words' numbers; spell(i) gives the i-th word, and is called for new ones only."""
        out = self.find(h, second)
        new = np.flatnonzero(out < 0)
        if len(new):
            order = new[np.lexsort((second[new], h[new]))]
            once = np.ones(len(order), bool)
            once[1:] = (h[order[1:]] != h[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            at = order[once]
            base = len(self.key)
            self.learn([spell(i) for i in at.tolist()])
            self.key, self.second = np.concatenate([self.key, h[at]]), np.concatenate([self.second, second[at]])
            if 2 * len(self.key) > len(self.slot):
                self.slot = np.full(4 * len(self.slot), -1, np.int32)
                base = 0
            number, slot = np.arange(base, len(self.key)), (self.key[base:] & U(len(self.slot) - 1)).astype(np.int64)
            while len(number):
                free = np.flatnonzero(self.slot[slot] < 0)
                _, one = np.unique(slot[free], return_index=True)
                self.slot[slot[free[one]]] = number[free[one]]
                more = np.ones(len(number), bool)
                more[free[one]] = False
                number, slot = number[more], (slot[more] + 1) & (len(self.slot) - 1)
            out[new] = self.find(h[new], second[new])
        return out

    def learn(self, words: list[str], most_symbols: int = 256) -> None:
        """Encodes new words, all together; they get the next numbers. Words of more than most_symbols bytes take the heap."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        special = np.array([w[0] == "\0" and w[1:] in self.special for w in words], bool)
        alone = np.flatnonzero(special | (size > most_symbols))
        ids = [np.array([self.special[words[k][1:]]] if special[k] else self._by_heap(raw[k]), np.int64) for k in alone.tolist()]
        rest = np.ones(len(words), bool)
        rest[alone] = False
        rest = np.flatnonzero(rest)
        symbol, word_of = self._by_waves(b"".join([raw[k] for k in rest.tolist()]), size[rest])
        owner = np.concatenate([rest[word_of], np.repeat(alone, [len(x) for x in ids])])
        symbol = np.concatenate([symbol, *ids])
        order = np.argsort(owner, kind="stable")
        self.pool = np.concatenate([self.pool, symbol[order].astype("<u4")])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(words)))])

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The pairs' ranks; -1 for those without a merge."""
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        return np.where(self.pair[at] == pairs, self.rank[at], -1) if len(self.pair) else np.full(len(pairs), -1)

    def _by_waves(self, joined: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words of these sizes, and the word of each.

        index: rank << 32 | position of every pair that has a merge, ordered; a pair's positions are a stretch of it.
        """
        n, end = len(joined), np.cumsum(size)
        last = np.zeros(n, np.int64)
        last[end - 1] = 1
        symbol = self.bytes[last, np.frombuffer(joined, np.uint8)]
        word_of = np.repeat(np.arange(len(size)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1], before[end - size] = -1, -1
        low, stale = np.empty(len(size), np.int64), np.zeros(n + 1, bool)  # the last place stands for no position

        def entries(at: np.ndarray) -> np.ndarray:
            """Index entries of the pairs that begin at these positions."""
            at = at[after[at] >= 0]
            rank = self.ranks(symbol[at] << 20 | symbol[after[at]])
            return np.sort(rank[rank >= 0] << 32 | at[rank >= 0])

        index = entries(np.arange(n))
        while len(index):
            at = index & 0xFFFFFFFF
            low[word_of[at[::-1]]] = index[::-1]  # each word's lowest active rank, and the first position that has it
            first = index[index == low[word_of[at]]]
            left = first & 0xFFFFFFFF
            right = after[left]
            symbol[left] = self.made_by_rank[first >> 32]
            symbol[right] = -1
            then = after[left] = after[right]
            before[then[then >= 0]] = left[then >= 0]
            changed = before[left]
            changed = changed[changed >= 0]
            for x in (left, right, changed):
                stale[x] = True
            more = entries(np.concatenate([left, changed]))  # one merge in each word: no position comes twice
            index = np.sort(np.concatenate([index[~stale[at]], more]), kind="stable")
            for x in (left, right, changed):
                stale[x] = False
        live = symbol >= 0
        return symbol[live], word_of[live]

    def _by_heap(self, raw: bytes) -> list[int]:
        """Symbols of one word: a map from each pair to its positions, and a heap of the active ranks."""
        symbol = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        size, merges = len(symbol), self.merges
        after, before = [*range(1, size), -1], list(range(-1, size - 1))
        at: dict[int, list[int]] = {}
        for i in range(size - 1):
            pair = symbol[i] << 20 | symbol[i + 1]
            if pair in merges:
                at.setdefault(pair, []).append(i)
        active = [(merges[p][0], p) for p in at]
        heapq.heapify(active)

        def enter(i: int) -> bool:
            """Enters the pair that begins at i; whether its rank is below the one that is being applied."""
            pair = symbol[i] << 20 | symbol[after[i]]
            found = merges.get(pair)
            if not found:
                return False
            if pair in at:
                at[pair].append(i)
            else:
                at[pair] = [i]
                heapq.heappush(active, (found[0], pair))
            return found[0] < rank

        while active:
            rank, pair = heapq.heappop(active)
            left, right, made = pair >> 20, pair & 0xFFFFF, merges[pair][1]
            places = sorted(at.pop(pair, ()))
            for n, i in enumerate(places):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = made, -1
                k = after[i] = after[j]
                lower = False
                if k >= 0:
                    before[k] = i
                    lower = enter(i)
                if before[i] >= 0:
                    lower = enter(before[i]) or lower
                if lower and n + 1 < len(places):  # a merge of a lower rank has come up and goes first
                    at.setdefault(pair, []).extend(places[n + 1 :])
                    heapq.heappush(active, (rank, pair))
                    break
        return [x for x in symbol if x >= 0]

    def word_numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, and where each text's begin (one more than texts)."""
        if len(self.key) > self.most_words:
            self.forget()
        joined = "\0".join(texts)
        if "<|" in joined or joined.count("\0") != len(texts) - 1:
            words = [self.split(t) for t in texts]
            flat_words = [w for own in words for w in own]
            both = np.frombuffer(b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in flat_words]), np.uint64).reshape(-1, 2)
            return self.number(both[:, 0].copy(), both[:, 1].copy(), flat_words.__getitem__), np.cumsum([0, *map(len, words)])
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        joined = joined.lower()
        start, end, h, second = self.cut_words(joined)
        numbers = self.number(h, second, lambda i: joined[start[i] : end[i]])
        stops, at = [], joined.find("\0")
        while at >= 0:
            stops.append(at)
            at = joined.find("\0", at + 1)
        return numbers, np.concatenate([[0], np.searchsorted(start, np.array(stops, np.int64)), [len(start)]]).astype(np.int64)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, as unsigned 32-bit little-endian integers, and where each text's begin (one more than texts)."""
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        w, cut = self.word_numbers(texts)
        n = self.first[w + 1] - self.first[w]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[w] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)]
        return ids, np.concatenate([[0], end])[cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, stops = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def decode(self, ids) -> str:
        """The tokens' strings with a space between two of them: the file names no decoder. Ids out of range are left out."""
        known = np.asarray(ids, np.int64)
        return " ".join(map(self.name.__getitem__, known[(known >= 0) & (known < len(self.has)) & self.has[np.clip(known, 0, len(self.has) - 1)]].tolist()))


_CODECS: dict[tuple, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The vocabulary of path, loaded once in each Python worker."""
    key = (path, os.path.getmtime(path))
    if key not in _CODECS:
        _CODECS[key] = BpeCodec(path)
    return _CODECS[key]


def text_groups(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts (null: empty) of about limit characters together, with the first one's place."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, [x or "" for x in texts[start : i + 1]]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, [x or "" for x in texts[start:]]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, and with keep_ids also ids (array of int) and decoded.

    Null and empty texts have no ids and decode to the empty text; a text is encoded whole, whatever its length. Rows
    may repeat, ids may be null, other columns are left out. No shuffle: each partition is a stage of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, part in text_groups(texts):
                got = [(x, bpe.decode(x)) for x in bpe.encode(part)]
                cols = [
                    keys.slice(start, len(part)), pa.array([len(x) for x, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x, _ in got]), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, t in got]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([t for _, t in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row's array of ids; a null array gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(run, f"id {kind}, text string")
