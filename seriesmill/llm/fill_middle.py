"""Fill-in-middle transformation (operator 13).

A document's units (lines) stand in an indexable skip list. Every link of its lanes carries two widths, in units and in
code points, so that going down the lanes by accumulated units reaches the unit at a cut and, on the way, adds up the
code points before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import flat

#: A line with its end, or a last one without.
LINE = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class SkipList:
    """Widths of units in their order, found by rank. Lane 0 has a link for each unit; a unit's tower reaches lane k with probability 4^-k.

    Lanes are lists in place of linked nodes, as units are only appended: link i of a lane leads from its node i to its
    node i + 1, and down[i] is the place of node i in the lane below. Node 0 is the head, which has all lanes.
    """

    def __init__(self, widths: Iterable[int] = ()):
        self.units, self.chars, self.down = [[]], [[]], [[0]]
        self._last = [(0, 0)]  # units and code points before the last node of each lane
        self.n = self.total = 0
        for width in widths:
            self.append(width)

    @staticmethod
    def _height(i: int) -> int:
        x = (i * 0x9E3779B97F4A7C15 ^ i >> 7) * 0xBF58476D1CE4E5B9 >> 24 & 0xFFFFFFFF
        k = 1
        while not x & 3 and k < 16:
            x, k = x >> 2, k + 1
        return k

    def append(self, width: int) -> None:
        self.n += 1
        self.total += width
        for k in range(self._height(self.n)):
            if k == len(self.units):
                self.units.append([])
                self.chars.append([])
                self.down.append([0])
                self._last.append((0, 0))
            u, c = self._last[k]
            self.units[k].append(self.n - u)
            self.chars[k].append(self.total - c)
            self._last[k] = self.n, self.total
            if k:
                self.down[k].append(len(self.units[k - 1]))

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank (from 0; the number of units gives all)."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        at = u = c = 0
        for k in range(len(self.units) - 1, -1, -1):
            units, chars, down = self.units[k], self.chars[k], self.down[k]
            while at < len(units) and u + units[at] <= rank:
                u += units[at]
                c += chars[at]
                at += 1
            at = down[at] if k else at
        return c


def unit_widths(text: str, unit: re.Pattern) -> list[int]:
    """Code points of each unit. What the pattern skips belongs to the unit after it, at the end to the last one."""
    if unit.pattern == LINE:
        parts = text.split("\n")
        return [len(x) + 1 for x in parts[:-1]] + ([len(parts[-1])] if parts[-1] else [])
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends[-1:] = [len(text)]
    return [b - a for a, b in zip([0, *ends], ends)]


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers below 2^32 for a document: the first four groups of eight digits of a SHA-256."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(text: str, doc_id, unit: re.Pattern, seed: int, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle (None if plain), and output of one text."""
    lanes = SkipList(unit_widths(text, unit))
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return lanes.n, PLAIN, None, None, text
    first, second = sorted((h1 % (lanes.n + 1), h2 % (lanes.n + 1)))
    a, b = lanes.seek(first), lanes.seek(second)
    before, middle, after = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm:
        return lanes.n, SPM, a, b - a, f"{s}{after}{p}{before}{m}{middle}"
    return lanes.n, PSM, a, b - a, f"{p}{before}{s}{after}{m}{middle}"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
    unit: str = LINE, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """struct `row` of the columns carry (all, by default), n, form, prefix_chars, middle_chars and output, for each row.

    A text is cut at two of its n + 1 unit borders, drawn by seed and id. rate: per cent of texts that are cut; spm: per
    cent of those with the suffix first. Empty and null texts (n = 0) and texts that hold a mark stay plain, with null
    prefix_chars and middle_chars. Prefix, middle and suffix may be empty. A null id draws as the empty string; rows that
    repeat id and text give the same output; an empty table gives an empty result. Marks are three different texts in
    which the first one's first character comes nowhere else, so that `restored` finds them. Nothing is shuffled.
    """
    starts = {m[:1] for m in marks}
    if len(set(marks)) != 3 or len(starts) != 1 or any(m.count(m[:1]) != 1 or len(m) < 2 for m in marks):
        raise ValueError("marks must be three different texts with the same first character, which comes nowhere else in them")
    names, pattern = docs.columns if carry is None else carry, re.compile(unit)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = flat(batch.column("text"))
            i = 0
            while i < batch.num_rows:  # outputs of about 4 MB
                j = max(i + 1, int((off <= off[i] + (4 << 20)).sum()) - 1)
                part = batch.slice(i, j - i)
                made = [cut(t or "", d, pattern, seed, rate, spm, marks) for d, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist())]
                n, form, a, m, out = zip(*made)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n, pa.int64()), pa.array(form), pa.array(a, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())], names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])
                i = j

    return rows.mapInArrow(each, f"row {rows.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, in plain Spark expressions: its marks come once each."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == PSM, F.concat(between(p, s), middle, between(s, m))).when(form == SPM, F.concat(between(p, m), middle, between(s, p))).otherwise(output)
