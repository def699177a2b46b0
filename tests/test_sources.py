"""Listings, digests, commits and log tails: empty and large files, writers at once, files that grow, move and are cut off."""

import hashlib
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from seriesmill.sources import commits, files, io
from seriesmill.streaming.streams import run_to_table
from seriesmill.streaming.tail import TailReader, cut_ranges, tail_lines


def put(root, path, data=b""):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(data)


def test_empty_markers_count_as_choices(spark, tmp_path):
    put(tmp_path, "r1/shorts/1This/short_2_x.mp4")
    put(tmp_path, "r2/shorts/1This/short_1_x.mp4")
    put(tmp_path, "r2/shorts/1This/short_3_x.mp4")
    put(tmp_path, "r3/shorts/1This/short_0_x.mp4")
    put(tmp_path, "r4/shorts/1This/sub/short_4_x.mp4")  # a folder further down isn't looked into
    put(tmp_path, "r5/shorts/other/short_4_x.mp4")
    put(tmp_path, "r6/shorts/1This/notes.txt", b"x")
    put(tmp_path, "r6/shorts/1This/short_5.mp4")
    got = io.scan_choices(spark, str(tmp_path), "1This").collect()
    assert sorted(map(tuple, got)) == [("r1", 1), ("r6", 4)]
    assert io.scan_choices(spark, f"file://{tmp_path}/nothing", "1This").count() == 0


def test_listing_has_all_files_of_all_levels(spark, tmp_path):
    for k in range(150):
        put(tmp_path, f"a{k % 7}/b{k % 3}/f{k}.JPG", b"x" * (k % 4))
    put(tmp_path, "top.png")
    got = {r["relative"]: r["length"] for r in files.list_files(spark, f"file://{tmp_path}/", folders_a_task=2).collect()}
    assert got == {f"a{k % 7}/b{k % 3}/f{k}.JPG": k % 4 for k in range(150)} | {"top.png": 0}
    assert {r["relative"] for r in files.list_files(spark, str(tmp_path), "a[12]/*/f*").collect()} == {x for x in got if x[:2] in ("a1", "a2")}
    media = io.scan_media(spark, str(tmp_path), ["png", ".jpg"])
    assert media.count() == 151 and media.first()["relative"].endswith("f0.JPG")


def test_digests_of_files_larger_than_an_array(spark, tmp_path):
    size = (2 << 30) + 12345  # beyond what a row can hold
    with open(tmp_path / "large.bin", "wb") as f:
        f.seek(size - 3)
        f.write(b"end")
    put(tmp_path, "empty")
    put(tmp_path, "é.txt", b"abc")
    want = hashlib.sha256()
    for _ in range(2 << 6):
        want.update(bytes(1 << 24))
    want.update(bytes(12345 - 3) + b"end")
    got = {r["relative_path"]: (r["bytes"], r["sha256"]) for r in io.content_inventory(spark, str(tmp_path)).collect()}
    assert got == {"large.bin": (size, want.hexdigest()), "empty": (0, hashlib.sha256().hexdigest()), "é.txt": (3, hashlib.sha256(b"abc").hexdigest())}
    gone = spark.createDataFrame([(f"{tmp_path}/gone",)], "path string")
    assert files.digests(gone).first()["sha256"] is None


def test_files_are_written_in_order_and_as_a_whole(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 5).cast("string").alias("f"), "id", F.concat(F.col("id").cast("string"), F.lit("\n")).alias("t"))
    assert files.write_files(rows.repartition(7), str(tmp_path), "f", ["id"], "t") == 5
    assert files.write_files(rows.where("id < 5"), str(tmp_path), "f", ["id"], "t") == 5  # replaces them
    assert files.write_files(rows.where("id < 100"), str(tmp_path), "f", ["id"], "t") == 5
    assert (tmp_path / "3").read_text() == "".join(f"{k}\n" for k in range(3, 100, 5)) and sorted(os.listdir(tmp_path)) == list("01234")


# ---------------------------------------------------------------- commits


def test_writers_at_once_all_commit_or_find_out(spark, tmp_path):
    path, won, lost = f"file://{tmp_path}/t", [], []

    def publish(k, expect):
        try:
            won.append(commits.publish_generation(spark.range(k + 1), path, expect=expect))
        except commits.CommitConflict:
            lost.append(k)

    for expect in (None, 3):
        won.clear()
        threads = [threading.Thread(target=publish, args=(k, expect)) for k in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert sorted(won) == ([0, 1, 2, 3] if expect is None else [4]) and len(lost) == (0 if expect is None else 3)
    log = commits.CommitLog(spark, path)
    assert log.versions() == [0, 1, 2, 3, 4] and len({log.get(v)["generation_id"] for v in log.versions()}) == 5
    assert not [x for x in os.listdir(tmp_path / "t/log") if x.endswith(".part")]
    assert sorted(commits.read_generation(spark, path, v).count() for v in range(4)) == [1, 2, 3, 4]


@pytest.mark.parametrize("links", [True, False])
def test_a_commit_is_put_once(spark, tmp_path, links):
    log = commits.CommitLog(spark, f"file://{tmp_path}/t")
    log._links = links
    assert log.latest() is None and log.put(0, {"generation_id": "a"}) and not log.put(0, {"generation_id": "b"}) and log.put(1, {"generation_id": "c"})
    assert log.get(0) == {"generation_id": "a"} and log.versions() == [0, 1]


def test_batches_are_published_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.publish_generation(spark.range(2), path, "a", 0) == 0
    assert commits.publish_generation(spark.range(9), path, "a", 0) == 0 and commits.read_generation(spark, path).count() == 2
    assert commits.publish_generation(spark.range(3), path, "b", 0) == 1 and commits.publish_generation(spark.range(4), path, "a", 1) == 2
    assert commits.publish_generation(spark.range(9), path, "a", 0) == 2  # an older batch of the same application
    add = commits.publish_batches(path, "c", lambda batch, table: table.unionByName(batch))
    add(spark.range(10), 0)
    add(spark.range(10), 0)
    assert commits.read_generation(spark, path).count() == 14
    with pytest.raises(commits.CommitConflict):
        commits.publish_generation(spark.range(1), path, expect=1)
    with pytest.raises(FileNotFoundError):
        commits.read_generation(spark, str(tmp_path / "none"))


def test_a_writer_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.publish_generation(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        commits.publish_generation(spark.range(5).select(F.raise_error(F.lit("broken")).alias("x")), path)
    assert commits.read_generation(spark, path).count() == 5 and commits.CommitLog(spark, path).versions() == [0]


# ---------------------------------------------------------------- tails


def rows_of(spark, logs, state, **options):
    return sorted((r["file"], r["position"], r["line"]) for r in run_to_table(tail_lines(spark, str(logs), **options), str(state)).collect())


def batch_rows(logs, names):
    """Whole lines of files as they are now, by position."""
    out = []
    for name in names:
        data, at = (logs / name).read_bytes(), 0
        for line in data.split(b"\n")[:-1]:
            out.append((name, at, line.rstrip(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
    return sorted(out)


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_tail_equals_a_batch_read_after_each_append(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    logs.mkdir()
    assert rows_of(spark, logs, state) == []
    append(logs / "a.log", b"one\ntwo\r\nthr")
    append(logs / "b.log", b"x" * 5000 + b"\n\n\xff\n")
    append(logs / "empty.log", b"")
    for more in (b"ee\nfour", b"", b"\n" + "é\n".encode() * 3000 + b"open", b" end\n"):
        assert rows_of(spark, logs, state, split_bytes=700) == batch_rows(logs, ["a.log", "b.log"])
        append(logs / "a.log", more)
    append(logs / "new.log", b"late\n")
    assert rows_of(spark, logs, state, split_bytes=700) == batch_rows(logs, ["a.log", "b.log", "new.log"])


def test_tail_follows_rotation_and_truncation(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    logs.mkdir()
    append(logs / "a.log", b"1\n2\n3")
    assert len(rows_of(spark, logs, state)) == 2
    append(logs / "a.log", b"3\n")
    os.rename(logs / "a.log", logs / "a.log.1")
    append(logs / "a.log.1", b"4\n")
    append(logs / "a.log", b"new 1\n")
    want = [("a.log", 0, "1"), ("a.log", 0, "new 1"), ("a.log", 2, "2"), ("a.log.1", 4, "33"), ("a.log.1", 7, "4")]
    assert rows_of(spark, logs, state) == want
    (logs / "a.log").write_bytes(b"cut\n")
    assert rows_of(spark, logs, state) == sorted([*want, ("a.log", 0, "cut")])
    os.remove(logs / "a.log.1")  # all of it was read
    append(logs / "a.log", b"on\n")
    assert rows_of(spark, logs, state) == sorted([*want, ("a.log", 0, "cut"), ("a.log", 4, "on")])


def test_a_batch_that_runs_again_reads_the_same_lines(tmp_path):
    """What a query does when it restarts from logged offsets, with the file rotated meanwhile."""
    append(tmp_path / "a.log", b"1\n2\n")
    reader = TailReader({"path": str(tmp_path)})
    start = reader.latestOffset()
    append(tmp_path / "a.log", b"3\n4\n5")
    end = json.loads(json.dumps(reader.latestOffset()))
    read = lambda r: [(b.column("position")[i].as_py(), b.column("line")[i].as_py()) for p in r.partitions(start, end) for b in r.read(p) for i in range(b.num_rows)]
    assert read(reader) == [(4, "3"), (6, "4")]
    os.rename(tmp_path / "a.log", tmp_path / "old.log")
    append(tmp_path / "a.log", b"other\n")
    assert read(TailReader({"path": str(tmp_path)})) == [(4, "3"), (6, "4")]
    os.remove(tmp_path / "old.log")
    with pytest.raises(FileNotFoundError):
        read(TailReader({"path": str(tmp_path)}))
    assert read(TailReader({"path": str(tmp_path), "failondataloss": "false"})) == []


def test_ranges_are_cut_and_put_together():
    got = cut_ranges([("p", "a", 0, 25), ("p", "b", 5, 8), ("p", "c", 0, 2)], 10)
    assert [[x[1:] for x in part] for part in got] == [[("a", 0, 10)], [("a", 10, 20)], [("a", 20, 25), ("b", 5, 8), ("c", 0, 2)]]


@pytest.mark.parametrize("split", range(1, 14))
def test_lines_belong_to_the_range_in_which_they_begin(tmp_path, split):
    data = b"ab\n\ncdefghij\nk\n" + b"l" * 20 + b"\n\n"
    append(tmp_path / "f", data)
    reader = TailReader({"path": str(tmp_path), "splitbytes": str(split)})
    got = [(b.column("position")[i].as_py(), b.column("line")[i].as_py()) for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for i in range(b.num_rows)]
    assert sorted(got) == [(at, line) for _, at, line in batch_rows(tmp_path, ["f"])]
