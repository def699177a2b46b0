"""Analytics over process logs (run_id, stage, attempt, stream, ts, line) and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of lines that report errors, fatal failures, and refusals for quota.
ERROR_PATTERNS = (r"\btraceback\b", r"\berror\b", r"\bexception\b", r"\bfailed\b", r"\bout of memory\b", r"\bOOM\b", r"\bquota\b", r"\bRESOURCE_EXHAUSTED\b", r"\bUSER_PROJECT_DENIED\b", r"\bunauthorized\b", r"\brefus(?:e|al|ed)\b")
FATAL_PATTERNS = (r"No such file or directory", r"FileNotFoundError", r"No supported images found", r"No supported music found", r"Music track does not exist", r"unrecognized arguments", r"Generated clip failed identity", r"Generated clip failed .* validation")
QUOTA_PATTERNS = (r"USER_PROJECT_DENIED", r"RESOURCE_EXHAUSTED", r"quota", r"rate.?limit", r"no available .*gpu", r"cannot .*gpu", r"temporar(?:y|ily)", r"backend.*unavailable", r"service unavailable", r"failed to assign.*backend", r"exceeded.*limit", r"not.*authorized.*colab")


def any_of(patterns: tuple[str, ...]) -> str:
    """One case-insensitive pattern for all."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def is_error_line(stream: Column, line: Column) -> Column:
    return (stream == "stderr") | line.rlike(any_of(ERROR_PATTERNS))


def route_error_lines(lines: DataFrame) -> DataFrame:
    """Lines for the error log; a filter, so it works on streams as well."""
    return lines.where(F.coalesce(is_error_line(F.col("stream"), F.col("line")), F.lit(False)))


def classify_failure(lines: DataFrame, attempts: DataFrame, keys: list[str], last: int = 300) -> DataFrame:
    """keys and class of each attempt (keys, timed_out, idle_timed_out), from its last lines; an attempt without lines is transient."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("line_no"))
    tail = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    flags = tail.groupBy(*keys).agg(F.bool_or(F.col("line").rlike(any_of(FATAL_PATTERNS))).alias("fatal"), F.bool_or(F.col("line").rlike(any_of(QUOTA_PATTERNS))).alias("quota"))
    kind = F.when(F.col("timed_out"), "stage-timeout").when(F.col("idle_timed_out"), "idle-timeout").when(F.col("fatal"), "fatal").when(F.col("quota"), "quota-or-refusal").otherwise("transient-or-unknown")
    return attempts.join(flags, keys, "left").select(*keys, kind.alias("failure_class"))


def retry_plan(attempts: DataFrame, by: list[str], order: str, refusals: int, short: int, quota: int, long: int) -> DataFrame:
    """quota_refusals so far, long_mode, wait_seconds of each failed attempt (failure_class). Long mode lasts once it has begun."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_quota = F.col("failure_class") == "quota-or-refusal"
    x = attempts.withColumn("quota_refusals", F.sum(is_quota.cast("int")).over(w)).withColumn("long_mode", F.col("quota_refusals") >= refusals)
    return x.withColumn("wait_seconds", F.when(F.col("long_mode") & is_quota, long).when(is_quota, quota).otherwise(short))


def idle_gaps(lines: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Lines that came more than `limit` seconds after the one before, with the gap."""
    w = Window.partitionBy(*by).orderBy("ts", "line_no")
    s = lambda c: F.unix_micros(c) / 1e6
    return lines.withColumn("gap", s(F.col("ts")) - s(F.lag("ts").over(w))).where(F.col("gap") > limit)


def stage_overruns(lines: DataFrame, by: list[str], limit: float) -> DataFrame:
    """by and seconds of the stages that lasted longer than `limit` from their first line to their last."""
    s = lambda c: F.unix_micros(c) / 1e6
    return lines.groupBy(*by).agg((s(F.max("ts")) - s(F.min("ts"))).alias("seconds")).where(F.col("seconds") > limit)


def run_progress(now: DataFrame, before: DataFrame, run: str, ident: str, done: str = "done") -> DataFrame:
    """For each run: items, finished, newly finished since the earlier snapshot, remaining."""
    a, b = now.select(run, ident, (F.col("status") == done).alias("d")), before.select(run, ident, (F.col("status") == done).alias("was"))
    x = a.join(b, [run, ident], "left")
    return x.groupBy(run).agg(F.count(F.lit(1)).alias("items"), F.count_if("d").alias("finished"), F.count_if(F.col("d") & ~F.coalesce("was", F.lit(False))).alias("newly_finished"), F.count_if(~F.col("d")).alias("remaining"))


def recent_output(lines: DataFrame, by: list[str], last: int = 40) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("line_no"))
    return lines.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= last)


def progress_watchdog(events: DataFrame, by: str, progress: Column, heartbeat: Column, quiet: float, silent: float) -> DataFrame:
    """since_progress, since_heartbeat (seconds, null before the first) and state at each event: stalled, lost or ok."""
    w = Window.partitionBy(by).orderBy("ts", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    s = F.unix_micros("ts") / 1e6
    x = events.withColumn("_s", s)
    x = x.withColumn("since_progress", F.col("_s") - F.max(F.when(progress, F.col("_s"))).over(w)).withColumn("since_heartbeat", F.col("_s") - F.max(F.when(heartbeat, F.col("_s"))).over(w))
    return x.withColumn("state", F.when(F.col("since_progress") > quiet, "stalled").when(F.col("since_heartbeat") > silent, "lost").otherwise("ok")).drop("_s")


def exit_class(code: Column) -> Column:
    return F.when(code == 0, "finished").when(code == 75, "allocation").when(code == 76, "stalled").when(code == 124, "timeout").otherwise("failed")


def attempt_accounting(attempts: DataFrame, by: str, order: list[str], limit: int = 3) -> DataFrame:
    """failures since the last progress, attempts used so far, and the wait class. Progress resets the failures; a transient failure without progress uses no attempt."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = attempts.withColumn("_g", F.sum(F.col("progress").cast("int")).over(w))
    inner = Window.partitionBy(by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("failures", F.sum((~F.col("progress") & F.col("failed")).cast("int")).over(inner))
    x = x.withColumn("used", F.sum((F.col("progress") | (F.col("failed") & ~F.col("transient"))).cast("int")).over(w))
    return x.withColumn("wait_class", F.when(~F.col("failed"), "none").when(F.col("failures") >= limit, "long").otherwise("short")).drop("_g")
