"""Joins, set operations, upserts and top-k forms that the cohort store is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_outer_concordance(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Every key of either side with both values and whether they match, differ or stand alone."""
    a, b = left.select(*key, F.col(value).alias("left_value")), right.select(*key, F.col(value).alias("right_value"))
    state = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(F.col("left_value") == F.col("right_value"), "match").otherwise("differ")
    return a.join(b, key, "full_outer").withColumn("state", state)


def resolve_alias(rows: DataFrame, aliases: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Rows with their dictionary entry, found by the canonical name of an alias or else by the name itself."""
    a = aliases.select(F.col("alias").alias("_alias"), "canonical")
    named = rows.join(a, F.upper(F.col(name)) == F.upper("_alias"), "left").withColumn("canonical", F.coalesce("canonical", name)).drop("_alias")
    return named.join(dictionary.withColumnRenamed("name", "canonical"), "canonical", "left")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], rank: Column | None = None) -> DataFrame:
    """Stored rows overwritten by new ones of the same key; with ``rank``, never by one that ranks lower."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc("_new")] if rank is None else [rank.desc(), F.desc("_new")]
    w = Window.partitionBy(*key).orderBy(*order)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows are added only where their key is not stored yet."""
    return stored.unionByName(new.join(stored, key, "left_anti"))


def cascade_delete(parent: DataFrame, children: list[tuple[DataFrame, str, str]], gone: DataFrame, key: str) -> list[DataFrame]:
    """The parent table and its chain of children without what hangs on ``gone``: each child is (rows, key, parent key)."""
    out = [parent.join(gone, key, "left_anti")]
    lost, lost_key = gone.select(key), key
    for rows, own, up in children:
        drop = rows.join(lost, rows[up] == lost[lost_key], "left_semi")
        out.append(rows.join(drop.select(own), own, "left_anti"))
        lost, lost_key = drop.select(own), own
    return out


def symmetric_sizes(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Sizes of the shared and private item sets of each pair of groups that share an item."""
    sets = rows.select(group, item).distinct()
    size = sets.groupBy(group).agg(F.count("*").alias("n"))
    a, b = sets.select(F.col(group).alias("a"), item), sets.select(F.col(group).alias("b"), item)
    both = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    na, nb = size.select(F.col(group).alias("a"), F.col("n").alias("na")), size.select(F.col(group).alias("b"), F.col("n").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"))


def due_queue(rows: DataFrame, status: str, due: Column, now: Column, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` pending rows that are due, first in first out; the limit is the feature."""
    return rows.where((F.col(status) == "PENDING") & (due <= now)).orderBy(*order).limit(n)


def backoff(attempt: Column, base: int = 60, cap: int = 3600) -> Column:
    """Seconds to wait after so many failures."""
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(float(cap))).cast("long")


def sync_action(local: Column, remote: Column, synced: Column) -> Column:
    """What to do with a record by its local, remote and last synchronised version; null means absent."""
    changed, moved = ~local.eqNullSafe(synced), ~remote.eqNullSafe(synced)
    return F.when(local.isNull(), "AdoptRemote").when(remote.isNull() | (changed & ~moved), "RePush").when(moved & changed & (local != remote), "Conflict").when(moved & (local != remote), "ApplyRemote").otherwise("InSync")
