"""Pulling a feed of changes into a replica, exactly once however often it is replayed.

A replica is a folder of Parquet tables and a folder of commits; a commit is a small file with the number of its version,
that names the table it made current and the cursor up to which the feed was read. A commit is created, never replaced:
of two writers that build on one version, the second finds the next commit there and is refused. A writer that is lost
before its commit leaves a table that nothing names. Deleted rows stay as tombstones, so that a change that comes late
can't bring one back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version that this one meant to make."""


class Replica:
    """Rows of a feed by key: the newest change of each key by ``order``, with ``deleted`` for tombstones."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], cursor: str, op: str = "op", delete: str = "D"):
        self.spark, self.path, self.key, self.order, self.cursor = spark, path.rstrip("/"), key, order, cursor
        self.op, self.delete = op, delete

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def head(self) -> dict:
        """The newest commit: version, table and cursor."""
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = sorted(int(n) for n in names if n.isdigit())
        if not done:
            return {"version": 0, "table": None, "cursor": None}
        text = self.spark.read.text(f"{self.path}/commits/{done[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, entry: dict) -> None:
        fs, p = self._fs()
        jvm = self.spark._jvm
        fs.mkdirs(p)
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{entry['version']}")
        # Written aside and moved, so that a commit is there as a whole or not at all; a move never replaces.
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"version {entry['version']} is there already")

    def state(self, head: dict | None = None) -> DataFrame | None:
        head = head or self.head()
        return self.spark.read.parquet(f"{self.path}/{head['table']}") if head["table"] else None

    def rows(self) -> DataFrame | None:
        """The rows that aren't deleted."""
        now = self.state()
        return None if now is None else now.where("not deleted").drop("deleted")

    def pull(self, changes: DataFrame, base: dict | None = None) -> dict:
        """Apply what lies past the cursor; the new commit, or the old one if nothing is new.

        ``base`` is the commit to build on (the newest, unless given). Repeated changes, changes that come out of order
        and whole replays lead to the same rows: a key keeps its greatest change by ``order``.
        """
        head = base or self.head()
        new = changes if head["cursor"] is None else changes.where(F.col(self.cursor) > head["cursor"])
        end = new.agg(F.max(self.cursor)).first()[0]
        if end is None:
            return head
        new = new.where(F.col(self.key).isNotNull()).withColumn("deleted", F.col(self.op) == self.delete).drop(self.op)
        now = self.state(head)
        both = new if now is None else now.unionByName(new)
        newest = both.groupBy(self.key).agg(F.max_by(F.struct(*both.columns), F.struct(*self.order)).alias("r")).select("r.*")
        table = f"tables/{head['version'] + 1}-{uuid.uuid4().hex}"
        newest.write.parquet(f"{self.path}/{table}")
        entry = {"version": head["version"] + 1, "table": table, "cursor": end}
        self._commit(entry)
        return entry
