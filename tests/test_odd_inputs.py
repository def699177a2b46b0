"""Queries against their SQL on odd inputs: empty and null texts, characters that regular expressions treat differently; trees of files, many log files, groups of any size."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import greedy
from seriesmill.plans import registry, run_queries
from seriesmill.sources import files
from seriesmill.streaming import tail


def same_as_sql(spark, name, folder, *tables):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.execute(registry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)


TOKENS = " |  |\n|\r\n|\x0b|\0|\x85|\xa0| | |\"|'|PROMPT|Prompt:|video prompt:|:|<think>|</think>|<thinK>|TWO_HANDS_CLEAR: yes|two_handſ_clear:no|yeſ|no|\xe9|_|x|́|İ".split("|")


@pytest.mark.parametrize("name", ["t1_clean_text", "t2_parse_response"])
def test_answers_of_any_characters(spark, tmp_path, name):
    rng = random.Random(5)
    texts = [None, "", *TOKENS, "\xe9PROMPT: x", 'x" ', *["".join(rng.choice(TOKENS) for _ in range(rng.randint(2, 9))) for _ in range(1000)]]
    rows = [(k * 6 + i, t) for k, t in enumerate(texts) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same_as_sql(spark, name, tmp_path, "documents") == len(rows)


def test_marker_trees_are_bounded_and_deleted(spark, tmp_path, monkeypatch):
    customers = [(k,) for k in [*range(300), 7, 7, None, 10**12]]
    spark.createDataFrame(customers, "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    most, write = [], run_queries.write_files

    def counted(rows, path, *more):
        most.append(rows.select(F.split("file", "/")[0]).distinct().count())
        return write(rows, path, *more)

    monkeypatch.setattr(run_queries, "write_files", counted)
    monkeypatch.setattr(run_queries, "shared_dir", lambda spark: f"file://{tmp_path}/shared/{len(most)}")
    assert same_as_sql(spark, "a4_empty_markers", tmp_path, "customer") > 0
    assert not [p for p in (tmp_path / "shared").glob("*/*")]
    assert run_queries.a4_tree(spark, str(tmp_path), 50).count() > 0 and len(most) == 8 and max(most[1:]) < 100 and sum(most[1:]) == 301


def test_a_tree_is_deleted_as_a_whole(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"t/{k}/a").mkdir(parents=True)
        (tmp_path / f"t/{k}/a/f").write_text("x")
        (tmp_path / f"t/f{k}").touch()
    (tmp_path / "other").touch()
    files.delete_tree(spark, f"file://{tmp_path}/t")
    files.delete_tree(spark, f"{tmp_path}/none")
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_many_log_files_are_planned_in_linear_time(monkeypatch, tmp_path):
    n, head = 30_000, lambda k: b"%08d" % k * 4
    names = [f"run-{k:08d}.log" for k in range(n)]
    entries = [[names[k], 64, 32, tail._digest(head(k))] for k in range(n)]
    reader = tail.TailReader({"path": str(tmp_path)})
    monkeypatch.setattr(reader, "_list", lambda: {names[k]: (64, head(k), 64) for k in range(n)})
    began = time.time()
    ranges = [r for p in reader.partitions({"files": entries[: n // 2]}, {"files": entries}) for r in p.ranges]
    assert [r[1] for r in ranges] == names[n // 2 :] and time.time() - began < 15
    moved = {f"old-{names[k]}": (64, head(k), 64) for k in range(n)}
    monkeypatch.setattr(reader, "_list", lambda: moved)
    began = time.time()
    ranges = [r for p in reader.partitions({"files": []}, {"files": entries}) for r in p.ranges]
    assert [r[1] for r in ranges] == list(moved) and time.time() - began < 15
    monkeypatch.setattr(reader, "_list", lambda: dict(list(moved.items())[1:]))
    with pytest.raises(FileNotFoundError):
        reader.partitions({"files": []}, {"files": entries})
    assert reader.partitions({"files": entries}, {"files": entries}) == []


@pytest.mark.parametrize("fold_rows", [0, 20, 100])
@pytest.mark.parametrize("limit", [None, 3])
def test_suppression_of_small_and_large_groups(spark, fold_rows, limit):
    rng = random.Random(6)
    sizes = {None: 40, 1: 5, 2: 20, 3: 21, 4: 300}
    rows = [(g, rng.randint(0, 500), rng.randint(0, 30)) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows + rows[:50], "g long, at long, q long").withColumn("hi", F.col("at") + 20)
    args = ["g"], [(-F.col("q")).alias("o1"), F.col("at").alias("o2")], ["at", "q"], lambda a, b: F.abs(a["at"] - b["at"]) < 20
    got = greedy.suppress_by_rounds(df, *args, "at", "hi", 15.0, limit, fold_rows).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, greedy.greedy_suppress(df, *args, limit).collect()))


def test_small_groups_are_not_stored(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(greedy, "stored", lambda df, put=greedy.stored: written.append(put(df)) or written[-1])
    lines = spark.range(20_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") * 7919 % 2000).alias("l_partkey"), (F.col("id") * 31 % 1009).cast("double").alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert same_as_sql(spark, "g1_suppress_by_rounds", tmp_path, "lineitem") > 0
    assert sum(x.count() for x in written) == 0
