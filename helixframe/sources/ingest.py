"""Ingesting folders of files, routed by what they are, once each however often it is run.

A store holds a table for each kind of file and a manifest: one row a file that was met, with its size and time, the
digest of its bytes, its kind, what became of it and how many rows it gave. A run lists the folders (no bytes are read),
leaves out files that the manifest has with the same size and time, reads the others once, leaves out those whose bytes
are known, and reads each kind's files by that kind's reader. Rows carry their file's path. The manifest's part is
written last: what a lost run wrote is overwritten by the next, and readers take only parts that the manifest names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import materialize
from helixframe.sources import tables
from helixframe.sources.files import file_type

#: Bytes of a file that its kind is told by.
HEAD_BYTES = 1 << 16
MANIFEST = "path string, length long, modified timestamp, digest string, kind string, outcome string, rows long"
#: Readers by kind: from lines (value, path) to rows that keep the path.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"chip_data": tables.chip_rows}


class Store:
    """Tables of what was ingested, under one folder."""

    def __init__(self, spark: SparkSession, path: str, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.path, self.readers = spark, path.rstrip("/"), readers or READERS

    def _parts(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [x for x in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName()) for x in done)

    def manifest(self) -> DataFrame:
        parts = [f"{self.path}/manifest/{k}" for k in self._parts()]
        return self.spark.read.schema(MANIFEST).parquet(*parts) if parts else self.spark.createDataFrame([], MANIFEST)

    def rows(self, kind: str) -> DataFrame | None:
        """What files of a kind gave, of all runs that ended."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        parts = [x for k in self._parts() if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x := f"{self.path}/{kind}/{k}"))]
        return self.spark.read.parquet(*parts) if parts else None

    def ingest(self, *folders: str) -> DataFrame:
        """The manifest's rows of this run: Imported, Duplicate, Empty or Unrecognised; none for files that are known."""
        spark = self.spark
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        listed = files.load(list(folders)).select("path", "length", F.col("modificationTime").alias("modified"))
        known = self.manifest()
        fresh = listed.join(known, ["path", "length", "modified"], "left_anti")
        # Names alone come to the driver, which lists the folders anyway.
        names = [r.path for r in fresh.select("path").collect()]
        if not names:
            return spark.createDataFrame([], MANIFEST)
        part = max(self._parts(), default=0) + 1
        head = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1")
        kind = file_type(F.element_at(F.split("path", "/"), -1), head)
        read = files.load(names).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), kind.alias("kind"))
        read = materialize(read, "digests")
        # Of equal files the first by path is read.
        first = read.join(known.select("digest").distinct(), "digest", "left_anti").groupBy("digest").agg(F.min("path").alias("path"))
        own = materialize(read.join(first, ["digest", "path"], "left_semi").select("path", "kind"), "routed")
        counts = None
        for name in sorted(self.readers):
            mine = [r.path for r in own.where(F.col("kind") == name).select("path").collect()]
            if not mine:
                continue
            lines = spark.read.text(mine).select("value", F.col("_metadata.file_path").alias("path"))
            out = f"{self.path}/{name}/{part}"
            self.readers[name](lines).write.mode("overwrite").parquet(out)
            n = spark.read.parquet(out).groupBy("path").agg(F.count("*").alias("rows"))
            counts = n if counts is None else counts.union(n)
        counts = counts if counts is not None else spark.createDataFrame([], "path string, rows long")
        done = read.join(own.select("path", F.lit(True).alias("first")), "path", "left").join(counts, "path", "left")
        readable = F.col("kind").isin(*self.readers)
        outcome = F.when(F.col("first").isNull(), "Duplicate").when(~readable, "Unrecognised").when(F.col("rows").isNull(), "Empty").otherwise("Imported")
        done = done.select("path", "length", "modified", "digest", "kind", outcome.alias("outcome"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
        done.write.mode("overwrite").parquet(f"{self.path}/manifest/{part}")
        return spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{part}")
