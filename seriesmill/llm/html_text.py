"""Main text of web pages (operator 12): a linear-chain conditional random field over a page's leaf blocks.

A block's features are the tags and names of its ancestors and measures of its text. The field has a score for each
feature and for each pair of neighbouring labels, apart for neighbours that stand in one element and others. It is
trained on labelled pages by its likelihood, and Viterbi's path picks the blocks of the article.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import chunks, flat
from seriesmill.llm.html_blocks import Block, Element, blocks

OTHER, MAIN = 0, 1
_SIZES = (1, 2, 3, 4, 6, 9, 14, 22, 40, 80)
_LANDMARKS = ("article", "main")
_MARKS = {"copy": "©", "bar": "|", "dot": "·", "arrow": "»", "at": "@"}

# ---------------------------------------------------------------- features


class Paths:
    """Features of elements from their tags and names and those of their ancestors, and the sum of their weights; kept for the elements of one page."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.known: dict[int, tuple[frozenset[str], float]] = {0: (frozenset(), 0.0)}

    def of(self, x: Element) -> tuple[frozenset[str], float]:
        if x.number not in self.known:
            above, score = self.of(x.parent)
            own = {f"t:{x.tag}"}
            for name in x.names:
                own.update((f"c:{name}", f"c:{name[:4]}-", f"c:{name[:3]}-") if len(name) > 4 else (f"c:{name}", f"c:{name[:3]}-") if len(name) > 3 else (f"c:{name}",))
            new = own - above
            self.known[x.number] = above | new, score + sum(self.weights.get(f, 0.0) for f in sorted(new))
        return self.known[x.number]


_CAPITALS, _DIGITS, _SPACES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" "


def text_features(block: Block) -> list[str]:
    """Measures of a block's whole text; shares are of bytes, capitals and digits ASCII's."""
    text = block.text
    words, raw = text.split(" "), text.encode("utf-8", "replace")
    n, size, tag = bisect_right(_SIZES, len(words)), len(text), block.at.tag
    solid = len(raw) - raw.count(_SPACES) or 1
    last, first = text[-1], text[0]
    stops = text.count(",") + text.count(". ")
    out = [
        f"n:{n}", f"tn:{tag}:{n}", f"own:{tag}", f"l:{bisect_right((0.001, 0.25, 0.6, 0.95), block.linked / size)}", f"p:{min(stops, 4)}",
        "e:stop" if last in ".?!…" else "e:colon" if last == ":" else "e:letter" if last.isalpha() else "e:digit" if last.isdigit() else "e:other",
        "s:upper" if first.isupper() else "s:lower" if first.islower() else "s:digit" if first.isdigit() else "s:other",
        f"u:{bisect_right((0.1, 0.3, 0.8), (len(raw) - len(raw.translate(None, _CAPITALS))) / solid)}", f"g:{bisect_right((0.001, 0.1, 0.4), (len(raw) - len(raw.translate(None, _DIGITS))) / solid)}",
        f"a:{bisect_right((3, 4.5, 6, 9), size / len(words))}",
    ]
    out += [f"x:{name}" for name, mark in _MARKS.items() if mark in text]
    out += [f"w:{w.strip('.,:;!?()').lower()[:20]}" for w in dict.fromkeys(words[:4] + words[-1:])]
    return out + [f"i:{name}" for name in block.inline]


def page_features(page: list[Block], paths: Paths) -> tuple[list[list[str]], list[int]]:
    """Features of each block beside those of its path, and 1 where it stands in the same element as the one before, or in a neighbour of that with the same names."""
    out, same = [], [0] * len(page)
    inside = [[f"t:{x}" in paths.of(b.at)[0] for b in page] for x in _LANDMARKS]
    there = [(x, own) for x, own in zip(_LANDMARKS, inside) if any(own)]
    for i, b in enumerate(page):
        own = text_features(b)
        own += [f"in:{x}:{b.at.tag}" if at[i] else f"o:{x}" for x, at in there] or ["nothing"]
        own.append(f"q:{min(4 * i // len(page), 3)}")
        if i == 0:
            own.append("first")
        else:
            before = page[i - 1].at
            same[i] = int(b.at is before or b.at.parent is before.parent and b.at.names == before.names)
        if i == len(page) - 1:
            own.append("last")
        out.append(own)
    return out, same


# ---------------------------------------------------------------- the field


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


class Field:
    """weights: score of the label MAIN for each feature; steps[s, a, b]: score of label b behind a, with s for neighbours in one element; start: of the first label."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, start: np.ndarray):
        self.weights, self.steps, self.start = weights, steps, start

    def decode(self, page: list[Block]) -> list[int]:
        """The best sequence of labels (Viterbi); ties go to OTHER."""
        if not page:
            return []
        paths, get = Paths(self.weights), self.weights.get
        features, same = page_features(page, paths)
        emit = [paths.of(b.at)[1] + sum([get(f, 0.0) for f in own]) for b, own in zip(page, features)]
        steps, back = self.steps.tolist(), []
        a, b = float(self.start[0]), float(self.start[1]) + emit[0]
        for k in range(1, len(page)):
            (oo, om), (mo, mm) = steps[same[k]]
            to_other, to_main = (a + oo, b + mo), (a + om, b + mm)
            back.append((to_other[1] > to_other[0], to_main[1] > to_main[0]))
            a, b = max(to_other), max(to_main) + emit[k]
        label = int(b > a)
        out = [label]
        for x in reversed(back):
            label = int(x[label])
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.15, shrink: float = 5e-5, least: int = 3) -> Field:
        """Largest likelihood of the labels, with a squared penalty on weights, by Adam's steps over all pages. Features on fewer than `least` pages are left out."""
        made = []
        for p, y in pages:
            if p:
                paths = Paths()
                features, same = page_features(p, paths)
                made.append(([own + sorted(paths.of(b.at)[0]) for b, own in zip(p, features)], same, np.array(y)))
        seen: dict[str, int] = {}
        for features, _, _ in made:
            for f in {f for own in features for f in own}:
                seen[f] = seen.get(f, 0) + 1
        index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
        longest, n = max((len(y) for *_, y in made), default=1), len(made)
        row, column = [], []
        there, label, same = np.zeros((longest, n), bool), np.zeros((longest, n), np.int64), np.zeros((longest, n), np.int64)
        for p, (features, s, y) in enumerate(made):
            there[: len(y), p], label[: len(y), p], same[: len(y), p] = True, y, s
            for k, own in enumerate(features):
                known = [index[f] for f in own if f in index]
                row += [k * n + p] * len(known)
                column += known
        row, column = np.array(row, np.int64), np.array(column, np.int64)
        size, blocks_n = len(index), max(1, int(there.sum()))
        w = np.zeros(size + 8 + 2)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            steps, start = w[size : size + 8].reshape(2, 2, 2), w[size + 8 :]
            emit = np.bincount(row, weights=w[column], minlength=longest * n).reshape(longest, n)
            score = np.stack([np.zeros_like(emit), emit], 2)
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = start + score[0]
            for k in range(1, longest):
                new = _log_sum(ahead[k - 1][:, :, None] + steps[same[k]], 1) + score[k]
                ahead[k] = np.where(there[k][:, None], new, ahead[k - 1])
            for k in range(longest - 2, -1, -1):
                new = _log_sum(steps[same[k + 1]] + (score[k + 1] + behind[k + 1])[:, None, :], 2)
                behind[k] = np.where(there[k + 1][:, None], new, behind[k + 1])
            total = _log_sum(ahead[-1], 1)
            chance = np.exp(ahead + behind - total[:, None]) * there[:, :, None]
            g = np.zeros_like(w)
            g[:size] = np.bincount(column, weights=((label * there) - chance[:, :, 1]).reshape(-1)[row], minlength=size)
            for k in range(1, longest):
                on = there[k]
                pair = np.exp(ahead[k - 1][:, :, None] + steps[same[k]] + (score[k] + behind[k])[:, None, :] - total[:, None, None])
                for s in (0, 1):
                    part = on & (same[k] == s)
                    g[size + 4 * s : size + 4 * s + 4] -= pair[part].sum(0).reshape(-1)
                    np.add.at(g, size + 4 * s + 2 * label[k - 1][part] + label[k][part], 1)
            g[size + 8 :] = np.bincount(label[0], minlength=2) - chance[0].sum(0) if n else 0
            g = g / blocks_n - shrink * w
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return cls({f: float(w[k]) for f, k in index.items()}, w[size : size + 8].reshape(2, 2, 2).copy(), w[size + 8 :].copy())

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "steps": self.steps.tolist(), "start": self.start.tolist()})

    @classmethod
    def from_json(cls, s: str) -> Field:
        x = json.loads(s)
        return cls(x["weights"], np.array(x["steps"]), np.array(x["start"]))


def labels_of(page: list[Block], text: str) -> list[int]:
    """Labels of a page's blocks when its main text (blocks joined by two line ends) is known: each block of the text is the next one on the page that equals it."""
    want = [" ".join(x.split()) for x in text.split("\n\n")] if text else []
    out, k = [OTHER] * len(page), 0
    for paragraph in want:
        for i in range(k, len(page)):
            if page[i].text == paragraph:
                out[i], k = MAIN, i + 1
                break
    return out


def train(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most_rows: int = 2_000) -> Field:
    """A field from labelled pages: their html and main text. At most most_rows different pages count, those of the smallest hashes; they are gathered in one task.

    Null html or text is empty. Without any page the field has no weights, so it finds no main text.
    """
    rows = labelled.select(F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).distinct()
    sample = rows.orderBy(F.xxhash64("html", "text"), "html", "text").limit(most_rows)

    def fit(t: pa.Table) -> pa.Table:
        pages = sorted(zip(t.column("html").to_pylist(), t.column("text").to_pylist()))
        parsed = [(p, labels_of(p, text)) for p, text in ((blocks(h), text) for h, text in pages)]
        return pa.table({"field": pa.array([Field.fit(parsed).to_json()], pa.string())})

    got = sample.groupBy(F.lit(1).alias("g")).applyInArrow(fit, "field string").collect()
    return Field.from_json(got[0]["field"]) if got else Field({}, np.zeros((2, 2, 2)), np.zeros(2))


# ---------------------------------------------------------------- pages


def main_text(page: str, field: Field) -> str:
    parsed = blocks(page)
    return "\n\n".join(b.text for b, label in zip(parsed, field.decode(parsed)) if label == MAIN)


def extract(pages: DataFrame, field: Field, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """struct `row` of the columns carry (all, by default) and text, for each row of pages.

    text: the blocks of the article, each with its white space made one space and trimmed, joined by two line ends in page
    order. Null and empty pages, and pages without an article, give the empty text. Repeated rows give equal results, an
    empty table gives an empty one. A page is parsed and decoded whole, in time and memory in proportion to its length.
    Nothing is shuffled; the field, whose size the labelled pages bound, goes to the tasks.
    """
    names = pages.columns if carry is None else carry
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{html_col}`").alias("html"))
    sent = pages.sparkSession.sparkContext.broadcast(field.to_json())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field.from_json(sent.value)
        for batch in batches:
            _, off = flat(batch.column("html"))
            for i, j in chunks(off, 4 << 20):
                part = batch.slice(i, j - i)
                texts = [main_text(h, own) for h in pc.fill_null(part.column("html"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return rows.mapInArrow(each, f"row {rows.schema['row'].dataType.simpleString()}, text string")
