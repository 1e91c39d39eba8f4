"""Adding, replacing and deleting documents; compaction; streams.

Changes are a log of rows (doc_id, version, deleted, fields ...) in append-only segments. The latest
row of each id counts; deletes are rows too, so nothing is rewritten before compaction.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.sources.store import Files


def upserted(docs: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with rows of changes added or put in place of those with the same id."""
    kept = docs.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_anti")


def live(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """The latest row of each id, deleted ones left out. An aggregate, so rows of one id meet after partial maxima.

    Among rows of one id and version the largest by its ordered columns counts.
    """
    best = latest(log, key)
    return best.filter("not deleted").drop("version", "deleted")


def latest(log: DataFrame, key: str = "doc_id") -> DataFrame:
    others = [c for c in log.columns if c != key]
    ordered = [c for c, kind in log.dtypes if c not in (key, "version") and not re.search(r"\bmap<|variant", kind)]
    best = log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("version", *ordered)).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in others])


@dataclass(frozen=True)
class Staged:
    version: int
    temp: str
    final: str


@dataclass
class DocumentLog:
    """A folder of segments. add/upsert/delete append one each; compact() puts one in the place of all.

    A segment's version is claimed by a file that only one writer can create, so no two writers share one
    and none deletes another's. Its name says what wrote it: a batch of a stream is found by its name and is
    not written twice, whatever other segments there are.
    """

    spark: SparkSession
    root: str
    key: str = "doc_id"

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def segments(self) -> list[str]:
        """Names s-<version>-<writer>, oldest first."""
        return sorted(n for n in self.files.names(self.root) if n.startswith("s-"))

    @staticmethod
    def version_of(name: str) -> int:
        return int(name.split("-")[1])

    def claims(self) -> list[int]:
        return sorted(self.version_of(n) for n in self.files.names(self.root) if n.startswith("c-"))

    def claim(self) -> int:
        """The next version, for this writer alone."""
        files = self.files
        version = max([0, *self.claims(), *map(self.version_of, self.segments())])
        while True:
            version += 1
            if files.create_new(f"{self.root}/c-{version:012d}"):
                return version

    def stage(self, rows: DataFrame, deleted: bool = False, writer: str | None = None) -> Staged:
        """Write a change that nobody sees before place()."""
        version = self.claim()
        temp = f"{self.root}/t-{uuid.uuid4().hex}"
        rows.withColumns({"deleted": F.lit(deleted), "version": F.lit(version).cast("long")}).write.parquet(temp)
        return Staged(version, temp, f"{self.root}/s-{version:012d}-{writer or uuid.uuid4().hex}")

    def place(self, staged: Staged) -> int:
        files = self.files
        if not files.fs.rename(files.path(staged.temp), files.path(staged.final)):
            raise OSError(f"{staged.final} could not be put in place")
        return staged.version

    def take_back(self, staged: Staged) -> None:
        """Drop a staged change, in place or not."""
        self.files.delete(staged.temp)
        self.files.delete(staged.final)

    def _append(self, rows: DataFrame, deleted: bool = False, writer: str | None = None) -> int:
        """A failed write leaves no segment."""
        return self.place(self.stage(rows, deleted, writer))

    def _place(self, rows: DataFrame, name: str) -> None:
        temp = f"{self.root}/t-{uuid.uuid4().hex}"
        rows.write.parquet(temp)
        self.place(Staged(self.version_of(name), temp, f"{self.root}/{name}"))

    def upsert(self, docs: DataFrame) -> int:
        return self._append(docs)

    add = upsert

    def delete(self, ids: DataFrame) -> int:
        return self._append(ids.select(self.key).distinct(), deleted=True)

    def has_batch(self, stream: str, number: int) -> bool:
        mark = f"{stream}-{number}"
        return any(n == f"b-{mark}" or (n.startswith("s-") and n.split("-", 2)[2] == mark) for n in self.files.names(self.root))

    def upsert_batch(self, docs: DataFrame, stream: str, number: int) -> int | None:
        """A micro-batch of a stream; one that is already there is left out."""
        if self.has_batch(stream, number):
            return None
        return self._append(docs, writer=f"{stream}-{number}")

    def log(self, names: list[str] | None = None) -> DataFrame:
        """All changes, or those of the named segments."""
        paths = [f"{self.root}/{n}" for n in (self.segments() if names is None else names)]
        if not paths:
            raise ValueError("the log is empty")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def documents(self, names: list[str] | None = None) -> DataFrame:
        """Live rows now, or as they were when segments() gave these names."""
        return live(self.log(names), self.key)

    def stats(self) -> DataFrame:
        """For each segment: rows, and rows that a later one replaced or deleted."""
        log = self.log().select(self.key, "version", "deleted", F.regexp_extract("_metadata.file_path", r"/s-(\d+)-", 1).cast("long").alias("segment"))
        last = log.groupBy(self.key).agg(F.max("version").alias("last"))
        rows = log.join(last, self.key)
        gone = F.count_if((F.col("version") < F.col("last")) | F.col("deleted"))
        return rows.groupBy("segment").agg(F.count("*").alias("doc_count"), gone.alias("deleted_count"))

    def segment_table(self) -> DataFrame:
        """stats() with each segment's size and time of writing: what the plans of segments.py read."""
        files, rows = self.files, []
        for n in self.segments():
            at = files.path(f"{self.root}/{n}")
            rows.append((self.version_of(n), files.fs.getContentSummary(at).getLength(), files.fs.getFileStatus(at).getModificationTime() / 1000))
        sizes = self.spark.createDataFrame(rows, "segment long, size_bytes long, created double")
        return self.stats().join(F.broadcast(sizes), "segment")  # one row a segment

    def compact(self, segments: list[int] | None = None) -> int:
        """The latest rows of all segments, or of the given ones, as one; the old ones go after it is there.

        Rows keep their versions, so a writer that claimed one before and ends later still counts. Deletes are
        kept where such a writer, or a segment left out, may still bring an older row.
        """
        names = [n for n in self.segments() if segments is None or self.version_of(n) in segments]
        if not names:
            raise ValueError("there are no such segments")
        top = max(map(self.version_of, names))
        there = {self.version_of(n) for n in self.segments()}
        older = any(v < top and v not in there for v in self.claims()) or any(self.version_of(n) < top and n not in names for n in self.segments())
        rows = latest(self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{n}" for n in names]), self.key)
        self._place(rows if older else rows.filter("not deleted"), f"s-{top:012d}-{uuid.uuid4().hex}")
        files = self.files
        for n in names:
            if "-" in n.split("-", 2)[2]:  # a stream's batch stays known
                files.create_new(f"{self.root}/b-{n.split('-', 2)[2]}")
            files.delete(f"{self.root}/{n}")
        return top

    def merge(self, plan: DataFrame) -> list[int]:
        """Carry out a plan of segments.py (by_size, by_deletion, by_time, balanced), highest priority first; a segment is merged once."""
        done: set[int] = set()
        for row in plan.orderBy(F.desc("priority")).collect():  # one row a merge
            part = [int(s) for s in row["segments"] if int(s) not in done]
            if part and (len(part) > 1 or row["strategy"] == "deletion"):
                self.compact(part)
                done |= set(part)
        return sorted(done)

    def vacuum(self) -> None:
        """Drop what failed writes have left; no writer may be at work."""
        files = self.files
        for n in files.names(self.root):
            if n.startswith(("t-", "c-")):
                files.delete(f"{self.root}/{n}")


@dataclass
class Transaction:
    """Changes to one or more logs that are seen together or not at all.

    isolation: "read_committed" reads what is there at each read; "repeatable_read" what was there at the
    start; "serializable" also refuses to commit if another writer has changed a log since.
    """

    logs: Mapping[str, DocumentLog]
    isolation: str = "read_committed"
    staged: list[tuple[str, Staged]] = field(default_factory=list)
    state: str = "active"

    def __post_init__(self):
        if self.isolation not in ("read_committed", "repeatable_read", "serializable"):
            raise ValueError(f"no such isolation: {self.isolation}")
        self.start = {name: log.segments() for name, log in self.logs.items()}

    def _active(self) -> None:
        if self.state not in ("active", "prepared"):
            raise ValueError(f"the transaction is {self.state}")

    def documents(self, name: str) -> DataFrame:
        return self.logs[name].documents(None if self.isolation == "read_committed" else self.start[name])

    def upsert(self, name: str, rows: DataFrame) -> None:
        self._stage(name, rows, False)

    def delete(self, name: str, ids: DataFrame) -> None:
        self._stage(name, ids.select(self.logs[name].key).distinct(), True)

    def _stage(self, name: str, rows: DataFrame, deleted: bool) -> None:
        self._active()
        try:
            self.staged.append((name, self.logs[name].stage(rows, deleted)))
        except Exception:
            self.abort()
            raise

    def prepare(self) -> None:
        """All changes are written; from here on only a conflict or a lost store stops the commit."""
        self._active()
        self.state = "prepared"

    def commit(self) -> list[int]:
        self._active()
        if self.isolation == "serializable" and any(self.logs[n].segments() != seen for n, seen in self.start.items()):
            self.abort()
            raise RuntimeError("another writer has changed the log")
        try:
            done = [self.logs[name].place(change) for name, change in self.staged]
        except Exception:
            self.abort()
            raise
        self.state = "committed"
        return done

    def abort(self) -> None:
        for name, change in self.staged:
            self.logs[name].take_back(change)
        self.state = "aborted"


def stream_into(stream: DataFrame, log: DocumentLog, checkpoint: str, trigger: dict | None = None):
    """A streaming query that appends every micro-batch as a segment, once: its checkpoint and number name it."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def batch(rows: DataFrame, number: int) -> None:
        others = [c for c in rows.columns if c != log.key]
        ordered = [c for c, kind in rows.dtypes if c != log.key and not re.search(r"\bmap<|variant", kind)]
        one = rows.groupBy(log.key).agg(F.max_by(F.struct(*others), F.struct(*ordered) if ordered else F.lit(0)).alias("x"))
        log.upsert_batch(one.select(log.key, *[F.col(f"x.{c}").alias(c) for c in others]), name, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, at: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; rows later than the watermark are dropped, as the watermark says."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), *keys).agg(F.count("*").alias("count"))
