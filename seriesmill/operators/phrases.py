"""Many phrases in one pass over a text: an automaton that is built once for each worker, from a list or a table of rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

try:  # the automaton in C; without it, the same in Python
    import ahocorasick
except ModuleNotFoundError:
    ahocorasick = None


class PhraseAutomaton:
    """Which of the phrases a text contains, in the phrases' order, each once. The empty phrase is in every text."""

    def __init__(self, phrases: list[str]):
        self.phrases = list(phrases)
        self.places: dict[str, list[int]] = {}
        for k, p in enumerate(self.phrases):
            self.places.setdefault(p, []).append(k)
        self.always = self.places.pop("", [])
        if ahocorasick is not None:
            self.made = ahocorasick.Automaton()
            for p in self.places:
                self.made.add_word(p, p)
            self.made.make_automaton()
        else:
            self._make()

    def _make(self) -> None:
        """Transitions, the phrases that end at a state (its own and its fallbacks'), and fallbacks, by breadth."""
        self.go, self.ends, self.fall = [{}], [()], [0]
        for p in self.places:
            at = 0
            for c in p:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.ends.append(())
                    self.fall.append(0)
                at = self.go[at][c]
            self.ends[at] += (p,)
        level = list(self.go[0].values())
        while level:
            below = []
            for at in level:
                self.ends[at] += self.ends[self.fall[at]]
                for c, to in self.go[at].items():
                    back = self.fall[at]
                    while back and c not in self.go[back]:
                        back = self.fall[back]
                    self.fall[to] = self.go[back].get(c, 0)
                    below.append(to)
            level = below

    def _hits(self, text: str) -> Iterator[str]:
        if ahocorasick is not None:
            if self.places:
                yield from (p for _, p in self.made.iter(text))
            return
        at = 0
        for c in text:
            while at and c not in self.go[at]:
                at = self.fall[at]
            at = self.go[at].get(c, 0)
            yield from self.ends[at]

    def found(self, text: str) -> list[str]:
        return [self.phrases[k] for k in sorted([*self.always, *(k for p in set(self._hits(text)) for k in self.places[p])])]


def recent_bans(history: DataFrame, phrases: DataFrame, last: int = 8, limit: int = 12) -> DataFrame:
    """recent_phrase_bans with a table of phrases (priority, phrase): bans are the phrases in the last texts of a run (run_id, idx, text), in order of (priority, phrase).

    The phrases, a few ten thousand at most, are collected; a row costs one pass over its last texts, however many they are.
    """
    listed = [r["phrase"] for r in phrases.where("phrase is not null").orderBy("priority", "phrase").select("phrase").collect()]
    sent = history.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = PhraseAutomaton(sent.value)
        for texts in batches:
            yield pd.Series([automaton.found(t)[:limit] for t in texts], dtype=object)

    w = Window.partitionBy("run_id").orderBy("idx").rowsBetween(-last, -1)
    return history.withColumn("bans", found(F.lower(F.concat_ws(" ", F.collect_list("text").over(w)))))


def with_rules(texts: DataFrame, rules: DataFrame, text: str = "text", style: str | None = None) -> DataFrame:
    """texts with violations, the names of the rules that a text breaks, in order of (priority, name).

    rules: name, kind, pattern, least, most, style, priority; at most a few ten thousand rows, which are collected. Kinds: `phrase` (the text,
    in lower case, contains the pattern), `pattern` (a Java and Python regular expression matches), `words` (the number of words lies
    outside least and most). style: the column of texts that a rule's style must equal; rules without a style hold for all. A null text
    breaks no rule. Phrases cost one pass over a text however many they are; each pattern costs a pass of its own.
    """
    listed = [r.asDict() for r in rules.select("name", "kind", "pattern", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "style", F.col("priority").cast("long").alias("priority")).orderBy("priority", "name").collect()]
    unknown = {r["kind"] for r in listed} - {"phrase", "pattern", "words"}
    if unknown:
        raise ValueError(f"unknown kinds of rules: {sorted(map(str, unknown))}")
    sent = texts.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("array<string>")
    def broken(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import re

        own = sent.value
        automaton = PhraseAutomaton(sorted({r["pattern"].lower() for r in own if r["kind"] == "phrase"}))
        patterns = {r["pattern"]: re.compile(r["pattern"]) for r in own if r["kind"] == "pattern"}

        def one(t: str | None, s: str | None) -> list[str] | None:
            if not isinstance(t, str):
                return []
            there, n, out = set(automaton.found(t.lower())), len(t.split()), []
            for r in own:
                if r["style"] is not None and r["style"] != s:
                    continue
                if r["kind"] == "phrase":
                    hit = r["pattern"].lower() in there
                elif r["kind"] == "words":
                    hit = (r["least"] is not None and n < r["least"]) or (r["most"] is not None and n > r["most"])
                else:
                    hit = patterns[r["pattern"]].search(t) is not None
                if hit and r["name"] not in out:
                    out.append(r["name"])
            return out

        for mine, styles in batches:
            yield pd.Series([one(t, s) for t, s in zip(mine, styles)], dtype=object)

    return texts.withColumn("violations", broken(F.col(text), F.col(style) if style else F.lit(None).cast("string")))
