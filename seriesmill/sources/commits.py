"""Generations of a table behind a log of numbered commits: readers see a whole generation, writers find out about each other.

A commit is a file `log/<number>.json` that can be put once only. It names its generation's folder, and for each
application the last batch that is in the table, so a batch that a stream delivers again is recognised.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(Exception):
    """Another writer has published since the version that this one built on."""


class CommitLog:
    """The commits below path. Needs a file system that renames without replacing in one step, as local ones and HDFS do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(f"{self.path}/log")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._links = self._fs.getScheme() == "file"

    def _file(self, version: int):
        return self._hadoop.Path(self._root, f"{version:020d}.json")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._root))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def get(self, version: int) -> dict:
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def put(self, version: int, entry: dict) -> bool:
        """Whether the commit of this number is now this entry; False if the number was taken."""
        temporary = self._hadoop.Path(self._root, f".{uuid.uuid4().hex}.part")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        try:
            if self._links:  # a link is made at once or not at all
                try:
                    os.link(temporary.toUri().getPath(), self._file(version).toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            context = self._hadoop.FileContext.getFileContext(self._root.toUri(), self.spark._jsc.hadoopConfiguration())
            rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
            keep = self.spark.sparkContext._gateway.new_array(rename, 1)
            keep[0] = rename.NONE
            try:
                context.rename(temporary, self._file(version), keep)
                return True
            except Exception as e:
                if "FileAlreadyExistsException" in str(e) or self._fs.exists(self._file(version)):
                    return False
                raise
        finally:
            self._fs.delete(temporary, False)


def publish_generation(df: DataFrame, path: str, app: str | None = None, batch_id: int | None = None, expect: int | None = None) -> int:
    """Writes df as a new generation below path and commits it; returns the commit's number (from 0).

    expect: the version that df was made from (-1 for none); if another one has been published since, CommitConflict is raised and the readers'
    table stays. Without it the last writer wins, and both commits remain. app and batch_id: a batch that is in the table already isn't written
    again, and its version (or that of a later batch of app) comes back. Data of a writer that failed lies below data/, where no commit names it.
    """
    log = CommitLog(df.sparkSession, path)
    before = log.latest()
    if expect is not None and (before if before is not None else -1) != expect:
        raise CommitConflict(f"version {before} was published, not {expect}")
    done = log.get(before)["batches"] if before is not None else {}
    if app is not None and batch_id is not None and done.get(app, [-1, -1])[0] >= batch_id:
        return done[app][1]
    generation = uuid.uuid4().hex
    df.write.parquet(f"{log.path}/data/generation_id={generation}")
    while True:
        version = 0 if before is None else before + 1
        batches = done | ({app: [batch_id, version]} if app is not None and batch_id is not None else {})
        if log.put(version, {"generation_id": generation, "batches": batches, "published_ms": int(time.time() * 1000), "rows_from": before}):
            return version
        if expect is not None:
            raise CommitConflict(f"version {version} was published meanwhile")
        before = log.latest()
        done = log.get(before)["batches"]
        if app is not None and batch_id is not None and done.get(app, [-1, -1])[0] >= batch_id:
            return done[app][1]  # the same batch, by another attempt


def read_generation(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The generation of the newest commit, or of a given one."""
    log = CommitLog(spark, path)
    version = log.latest() if version is None else version
    if version is None:
        raise FileNotFoundError(f"nothing is published below {path}")
    return spark.read.parquet(f"{log.path}/data/generation_id={log.get(version)['generation_id']}")


def publish_batches(path: str, app: str, made: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: publishes made(batch, the published table or None) for each batch, once, however often it is delivered."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, path)
        last = log.latest()
        if last is not None and log.get(last)["batches"].get(app, [-1])[0] >= batch_id:
            return
        publish_generation(made(batch, read_generation(spark, path, last) if last is not None else None), path, app, batch_id, -1 if last is None else last)

    return run
