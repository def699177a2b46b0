"""Streams whose rows must be taken in order, and alarms that come without input: processors with state and timers.

They keep their state in RocksDB (`rocksdb_state` sets the session so) and need protobuf in the Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesmill.operators.phrases import PhraseAutomaton


def rocksdb_state(spark: SparkSession) -> None:
    """Lets this session's streams keep their state in RocksDB, which processors with timers and lists demand."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---------------------------------------------------------------- rules over ordered texts


class RecentRules(StatefulProcessor):
    """T5, T6 and T7 for each text of a run in order of idx. State: the next idx, what the rules need of the last texts, and texts that came too early."""

    def __init__(self, phrases: list[str], lead: str, reaction: str, limits: dict[str, int], patience_ms: int | None):
        self.phrases, self.lead, self.reaction, self.limits, self.patience = phrases, lead, reaction, limits, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "idx long, held long, timer long")
        self.recent = handle.getListState("recent", "text string, lead string, reaction boolean")
        self.waiting = handle.getMapState("waiting", "idx long", "text string")
        self.automaton = PhraseAutomaton(self.phrases)
        self.find_lead, self.find_reaction = re.compile(self.lead), re.compile(self.reaction)

    def _judge(self, run, idx: int, text: str | None, past: list[tuple]) -> tuple:
        x = self.limits
        window = lambda n: past[-n:] if n else []
        bans = self.automaton.found(" ".join(t for t, _, _ in window(x["ban_last"]) if t is not None).lower())[: x["ban_limit"]]
        lead = reaction = None
        if text is not None:
            m = self.find_lead.search(text)
            lead, reaction = (m[0].lower() if m else ""), bool(self.find_reaction.search(text))
        often = sum(v == lead for _, v, _ in window(x["lead_last"])) >= x["lead_times"] if lead is not None else False
        reacted = sum(bool(v) for _, _, v in window(x["reaction_last"])) >= x["reaction_times"]
        slot = idx % x["every"] == x["every"] - 1
        past.append((text, lead, reaction))
        del past[: max(0, len(past) - max(x["ban_last"], x["lead_last"], x["reaction_last"]))]
        unknown = reaction is None
        return run, idx, bans, lead, (lead != "" and often) if lead is not None else (None if often else False), (None if reacted else False) if unknown else reaction and reacted, (True if slot else None) if unknown else not reaction or slot

    def _release(self, key: tuple, idx: int, held: int, timer: int, early: dict[int, str | None], now: int, skip: bool) -> Iterator[pd.DataFrame]:
        past, out = [tuple(x) for x in self.recent.get()], []
        while True:
            if idx in early:
                text = early.pop(idx)
            elif held and self.waiting.containsKey((idx,)):
                (text,) = self.waiting.getValue((idx,))
                self.waiting.removeKey((idx,))
                held -= 1
            elif skip and held:
                idx, skip = min(k for (k,) in self.waiting.keys()), False
                continue
            else:
                break
            out.append(self._judge(key[0], idx, text, past))
            idx += 1
        for k, text in early.items():
            if not self.waiting.containsKey((k,)):
                held += 1
            self.waiting.updateValue((k,), (text,))
        if self.patience is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = now + self.patience if held else -1
            if held:
                self.handle.registerTimer(timer)
        if out:
            self.recent.put(past)
        self.next.update((idx, held, timer))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "idx", "bans", "lead", "repeats_lead", "repeats_reaction", "reaction_allowed"]).astype({"repeats_lead": object, "repeats_reaction": object, "reaction_allowed": object})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        idx, held, timer = self.next.get() if self.next.exists() else (0, 0, -1)
        early: dict[int, str | None] = {}
        for pdf in rows:
            for k, text in zip(pdf["idx"].tolist(), pdf["text"].tolist()):
                if k >= idx:
                    early.setdefault(int(k), text if isinstance(text, str) else None)
        yield from self._release(key, idx, held, timer, early, timerValues.getCurrentProcessingTimeInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        idx, held, _ = self.next.get()
        yield from self._release(key, idx, held, -1, {}, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


RULES = "run_id long, idx long, bans array<string>, lead string, repeats_lead boolean, repeats_reaction boolean, reaction_allowed boolean"


def recent_rules_in_order(
    prompts: DataFrame, phrases: list[str], lead: str, reaction: str, ban_last: int = 8, ban_limit: int = 12, lead_last: int = 8, lead_times: int = 2,
    reaction_last: int = 4, reaction_times: int = 2, every: int = 5, patience: float | None = None,
) -> DataFrame:
    """bans, lead, repeats_lead, repeats_reaction and reaction_allowed for each row of a stream (run_id, idx, text), as recent_phrase_bans, repeat_lead and repeat_reaction give in batch.

    A run's rows are numbered from 0. They may come in any order over any triggers: one that comes before its turn waits in
    the state, one whose idx has been answered is left out (deliveries may repeat). With patience, a row that is still missing so many seconds
    after a run's last row came is passed over; without it, what is behind a hole waits for ever. lead and reaction are patterns
    that mean the same in Java and Python. A null text has no lead and no reaction, but takes its place among the last ones.
    """
    rocksdb_state(prompts.sparkSession)
    limits = {"ban_last": ban_last, "ban_limit": ban_limit, "lead_last": lead_last, "lead_times": lead_times, "reaction_last": reaction_last, "reaction_times": reaction_times, "every": every}
    processor = RecentRules(phrases, lead, reaction, limits, None if patience is None else int(patience * 1000))
    return prompts.select("run_id", "idx", "text").groupBy("run_id").transformWithStateInPandas(processor, RULES, "Append", "None" if patience is None else "ProcessingTime")


# ---------------------------------------------------------------- counters in order of event time


class QuotaInOrder(StatefulProcessor):
    """Holds attempts until the watermark has passed them, then counts them in order of (ts, attempt)."""

    def __init__(self, keys: list[str], refusals: int, waits: tuple[int, int, int]):
        self.keys, self.refusals, self.waits = keys, refusals, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, attempt long, failure_class string")
        self.counter = handle.getValueState("counter", "n long, timer long")

    def _get(self) -> tuple[int, int]:
        return self.counter.get() if self.counter.exists() else (0, -1)

    def _await(self, n: int, timer: int, first_us: int) -> None:
        due = -(-first_us // 1000)
        if timer < 0 or due < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.counter.update((n, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(a), c if isinstance(c, str) else None) for pdf in rows for us, a, c in zip(pdf["us"].tolist(), pdf["attempt"].tolist(), pdf["failure_class"].tolist())]
        self.pending.appendList(new)
        self._await(*self._get(), min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self._get()
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(x) for x in self.pending.get()), key=lambda x: x[:2])
        due, later = [x for x in rows if x[0] <= edge], [x for x in rows if x[0] > edge]
        out = []
        for us, attempt, kind in due:
            is_quota = kind == "quota-or-refusal"
            n += is_quota
            long = n >= self.refusals
            short_wait, quota_wait, long_wait = self.waits
            out.append((*key, attempt, n, long, long_wait if long and is_quota else quota_wait if is_quota else short_wait))
        if later:
            self.pending.put(later)
            self._await(n, -1, later[0][0])
        else:
            self.pending.clear()
            self.counter.update((n, -1))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "attempt", "quota_refusals", "long_mode", "wait_seconds"])

    def close(self) -> None:
        pass


def quota_in_order(attempts: DataFrame, by: list[str], refusals: int, short: int, quota: int, long: int, late: str = "10 minutes") -> DataFrame:
    """by, attempt, quota_refusals, long_mode, wait_seconds for each row of a stream of attempts (by, attempt, ts, failure_class), as retry_plan gives in order of (ts, attempt).

    An attempt may come up to `late` of event time behind the newest one of the stream; it waits until the watermark has passed it, so
    the state holds a key's attempts of that span. What comes later still is dropped. Counts are kept for each key.
    """
    rocksdb_state(attempts.sparkSession)
    x = attempts.select(*by, "attempt", "ts", F.unix_micros("ts").alias("us"), "failure_class").withWatermark("ts", late)
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in by)
    return x.groupBy(*by).transformWithStateInPandas(QuotaInOrder(by, refusals, (short, quota, long)), f"{kinds}, attempt long, quota_refusals long, long_mode boolean, wait_seconds int", "Append", "EventTime")


# ---------------------------------------------------------------- alarms


class Watchdog(StatefulProcessor):
    """Says when a run makes no progress, or gives no sign of life, and when it goes on again. State: times of both, what was said last, and the timer."""

    def __init__(self, key: str, quiet_ms: int, silent_ms: int):
        self.key, self.quiet, self.silent = key, quiet_ms, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "progress long, heartbeat long, said string, timer long")

    def _say(self, key, state: str, now: int, progress: int, heartbeat: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "state": [state], "at": pd.to_datetime([now], unit="ms"), "since_progress": [(now - progress) / 1000], "since_heartbeat": [(now - heartbeat) / 1000]})

    def _arm(self, progress: int, heartbeat: int, said: str, timer: int) -> None:
        """The next moment at which something is to be said; none once the run has stalled."""
        if timer >= 0:
            self.handle.deleteTimer(timer)
        due = [progress + self.quiet + 1] * (said != "stalled") + [heartbeat + self.silent + 1] * (said == "ok")
        timer = min(due, default=-1)
        if timer >= 0:
            self.handle.registerTimer(timer)
        self.last.update((progress, heartbeat, said, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        progress, heartbeat, said, timer = self.last.get() if self.last.exists() else (now, now, "ok", -1)
        moved = beat = False
        for pdf in rows:
            moved, beat = moved or bool(pdf["progress"].any()), beat or bool(pdf["heartbeat"].any())
        was = (progress, heartbeat)
        progress, heartbeat = now if moved else progress, now if beat else heartbeat
        state = "stalled" if now - progress > self.quiet else "lost" if now - heartbeat > self.silent else "ok"
        self._arm(progress, heartbeat, state, timer)
        if state != said:
            yield self._say(key, state, now, *(was if state == "ok" else (progress, heartbeat)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        progress, heartbeat, said, _ = self.last.get()
        state = "stalled" if now - progress > self.quiet else "lost" if now - heartbeat > self.silent else "ok"
        self._arm(progress, heartbeat, state, -1)
        if state != said:
            yield self._say(key, state, now, progress, heartbeat)

    def close(self) -> None:
        pass


def live_watchdog(lines: DataFrame, by: str, progress: Column, heartbeat: Column, quiet: float, silent: float) -> DataFrame:
    """by, state, at, since_progress, since_heartbeat: a row whenever the state of a run changes, from a stream of log lines; no line need come for it.

    stalled: more than `quiet` seconds of processing time without a line that is progress; else lost: more than `silent` seconds
    without one that is a heartbeat (let every line be one for plain idleness); else ok, which is said only after an alarm. Times
    begin with a run's first line. A run that is stalled says nothing more until it moves. Run it with a processing-time trigger.
    """
    rocksdb_state(lines.sparkSession)
    x = lines.select(by, F.coalesce(progress, F.lit(False)).alias("progress"), F.coalesce(heartbeat, F.lit(False)).alias("heartbeat"))
    kind = x.schema[by].dataType.simpleString()
    out = f"{by} {kind}, state string, at timestamp, since_progress double, since_heartbeat double"
    return x.groupBy(by).transformWithStateInPandas(Watchdog(by, int(quiet * 1000), int(silent * 1000)), out, "Append", "ProcessingTime")
