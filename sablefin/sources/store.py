"""Index folders: immutable version directories, and numbered manifests, the newest of which names the current one.

A commit writes a new version and then the next manifest, under a number that only one writer can create. No
manifest is ever replaced, and one that is not whole is passed over: readers see a whole version or the one before.
All paths go through Hadoop's file systems, so a store may be on any of them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.functions.analyzers import PerField, fingerprint, named_analyzers
from sablefin.operators.index import TABLES, Index, field_stats_of, laid_out, norms_of, sizes_of


class Files:
    """The few file operations a store needs."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.jvm = jvm

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def create_new(self, path: str, text: str = "") -> bool:
        """Write a file that must not be there yet; False if it is."""
        try:
            stream = self.fs.create(self.path(path), False)
        except Py4JJavaError as e:
            if self.exists(path):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True


@dataclass
class Store:
    """A folder of versions of one index (or of sub-stores by prefix)."""

    spark: SparkSession
    root: str

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def prefixed(self, prefix: str) -> Store:
        return Store(self.spark, f"{self.root}/{prefix}")

    def numbers(self) -> list[int]:
        """Of the manifests, newest first."""
        found = (re.fullmatch(r"manifest-(\d+)\.json", n) for n in self.files.names(self.root))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def exists(self) -> bool:
        return bool(self.numbers())

    def manifest(self) -> dict:
        for n in self.numbers():
            try:
                return json.loads(self.files.read(f"{self.root}/manifest-{n:012d}.json"))
            except ValueError:  # its writer is not done, or died
                continue
        raise FileNotFoundError(f"no index at {self.root}")

    def versions(self) -> list[str]:
        return [n for n in self.files.names(self.root) if n.startswith("v-")]

    def delete(self) -> bool:
        return self.files.delete(self.root)

    def stage(self, index: Index, files_a_table: int | None = None, more: Mapping[str, DataFrame] | None = None) -> str:
        """Write a version, with more tables beside the index's; it is not current before commit()."""
        name = f"v-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        n = files_a_table or int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        sizes = None
        if index.terms is not None:
            sizes_of(index.terms).write.parquet(f"{at}/sizes")
            sizes = self.spark.read.parquet(f"{at}/sizes")
            sizes.select("field", "doc_id", "len").write.parquet(f"{at}/lengths")
        else:
            index.lengths.write.parquet(f"{at}/lengths")
        # By range of (field, term), so that a frequent term spreads over files and rare ones share them.
        once = sizes is not None and sizes.groupBy("field", "doc_id").count().filter("count > 1").isEmpty()
        if once:
            postings = laid_out(index, sizes, n)
        else:  # rows of one id have to meet
            postings = index.postings.repartitionByRange(n, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
        postings.write.parquet(f"{at}/postings")
        written = self.spark.read.parquet(f"{at}/postings")
        stats = written.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        stats.repartitionByRange(n, "field", "term").sortWithinPartitions("field", "term").write.parquet(f"{at}/term_stats")
        index.docs.write.parquet(f"{at}/docs")
        (sizes.filter("n_terms > 0").select("field", "doc_id", "n_terms", "s1", "s2") if once else norms_of(written)).write.parquet(f"{at}/norms")
        field_stats_of(self.spark.read.parquet(f"{at}/lengths")).coalesce(1).write.parquet(f"{at}/field_stats")
        self.files.delete(f"{at}/sizes")
        for table, df in (more or {}).items():
            df.write.parquet(f"{at}/{table}")
        return name

    def commit(self, version: str, fields: tuple[str, ...], analyzers: PerField | None = None, **more) -> int:
        """Make a version current. What the index was analysed with is kept by fingerprint."""
        marks = {f: fingerprint((analyzers or PerField()).of(f)) for f in fields}
        text = json.dumps({"version": version, "fields": list(fields), "analyzers": marks, **more})
        number = max([0, *self.numbers()])
        while True:
            number += 1
            if self.files.create_new(f"{self.root}/manifest-{number:012d}.json", text):
                return number

    def rollback(self, version: str) -> None:
        """Drop a staged version that was not committed."""
        if self.exists() and self.manifest()["version"] == version:
            raise ValueError("the version is current")
        self.files.delete(f"{self.root}/{version}")

    def save(self, index: Index, more: Mapping[str, DataFrame] | None = None, **said) -> str:
        version = self.stage(index, more=more)
        self.commit(version, index.fields, index.analyzers, tables=sorted(more or {}), **said)
        return version

    def open(self, analyzers: PerField | None = None) -> Index:
        """The current version. Its analyzers are found if they are among the library's; others must be given, and fit."""
        found = self.manifest()
        marks = found["analyzers"]
        if analyzers is None:
            known = {fingerprint(a): a for a in named_analyzers()}
            lost = sorted(f for f, m in marks.items() if m not in known)
            if lost:
                raise ValueError(f"give the analyzers that this index was built with; fields: {', '.join(lost)}")
            analyzers = PerField(by_field={f: known[m] for f, m in marks.items()})
        other = sorted(f for f, m in marks.items() if fingerprint(analyzers.of(f)) != m)
        if other:
            raise ValueError(f"this index was built with other analyzers; fields: {', '.join(other)}")
        tables = {t: self.table(t, found) for t in TABLES}
        return Index(**tables, fields=tuple(found["fields"]), analyzers=analyzers)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{(manifest or self.manifest())['version']}/{name}")

    def vacuum(self) -> list[str]:
        """Delete all versions but the current one, and all manifests before its own."""
        current = self.manifest()["version"]
        old = [v for v in self.versions() if v != current]
        for v in old:
            self.files.delete(f"{self.root}/{v}")
        for n in self.numbers()[1:]:
            self.files.delete(f"{self.root}/manifest-{n:012d}.json")
        return old
