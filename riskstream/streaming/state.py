"""State tables of the stream: written once an epoch, merged by levels.

An epoch adds one part to a table, ``<table>/epoch=E``. When a level holds
``fanout`` parts they are merged into one part of the next level, named after
the newest epoch in it, so ``E`` epochs leave fewer than ``fanout`` parts on each of
``log(E)`` levels, and a row is rewritten once a level. Which parts are in force
is written with each epoch, a manifest: no part is listed to read or to expire it.

Restarts: an epoch that runs again reads the manifest of the one before it and
writes the same parts over. A part that a merge or an expiry takes out of the
manifest of epoch E is deleted by the epoch after E, when E can't run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, list_path

FANOUT = 16
PARTS = "array<struct<tbl: string, level: int, epoch: long, last_day: long>>"


@dataclass(frozen=True)
class Part:
    tbl: str
    level: int
    epoch: int
    last_day: int | None = None     # newest day in it; None: it does not expire

    @property
    def path(self) -> str:
        return f"{self.tbl}{f'-{self.level}' if self.level else ''}/epoch={self.epoch}"


@dataclass(frozen=True)
class Table:
    """``merge`` makes the rows of one part of those of several, which have
    ``epoch``, the newest epoch of their part."""
    name: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    by_day: bool = False

    def read(self, spark: SparkSession, state: str, parts: Sequence[Part]) -> DataFrame:
        own = [p for p in parts if p.tbl == self.name]
        schema = self.schema + (", day long" if self.by_day else "") + ", epoch long"
        if not own:
            return spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [
            spark.read.schema(schema).option("basePath", f"{state}/{p[0].path.split('/')[0]}").parquet(*[f"{state}/{x.path}" for x in p])
            for p in ([x for x in own if x.level == level] for level in sorted({x.level for x in own}))])

    def write(self, d: DataFrame, state: str, part: Part) -> None:
        w = d.drop("epoch").write.mode("overwrite")
        (w.partitionBy("day") if self.by_day else w).parquet(f"{state}/{part.path}")


def numbered(spark: SparkSession, path: str) -> list[int]:
    """Epochs that a folder has."""
    return sorted(int(name[6:]) for name in list_path(spark, path) if name.startswith("epoch="))


def merge_levels(spark: SparkSession, state: str, parts: Sequence[Part], tables: Sequence[Table], epoch: int,
                 fanout: int) -> list[Part]:
    """The parts after every full level has been merged into the next one."""
    parts = list(parts)
    for t in tables:
        level = 0
        while len(full := [p for p in parts if p.tbl == t.name and p.level == level]) >= fanout:
            into = Part(t.name, level + 1, epoch, max((p.last_day for p in full if p.last_day is not None), default=None))
            t.write(t.merge(t.read(spark, state, full)), state, into)
            parts = [p for p in parts if p not in full] + [into]
            level += 1
    return parts


def remove(spark: SparkSession, state: str, paths: Sequence[str]) -> None:
    for p in paths:
        delete_path(spark, f"{state}/{p}")


@dataclass(frozen=True)
class Log:
    """One such table in a folder of its own: what micro-batches append, and
    its rows as of the last epoch."""
    table: Table
    folder: str
    fanout: int = FANOUT

    def _manifest(self, spark: SparkSession, epoch: int) -> tuple[list[Part], list[str]]:
        r = spark.read.schema(f"parts {PARTS}, dropped array<string>").parquet(f"{self.folder}/meta/epoch={epoch}").first()
        return [Part(*p) for p in r["parts"]], r["dropped"]

    def append(self, d: DataFrame, epoch: int) -> None:
        spark = d.sparkSession
        before = [e for e in numbered(spark, f"{self.folder}/meta") if e < epoch]
        old, gone = self._manifest(spark, before[-1]) if before else ([], [])
        own = Part(self.table.name, 0, epoch)
        self.table.write(d, self.folder, own)
        parts = merge_levels(spark, self.folder, [*old, own], [self.table], epoch, self.fanout)
        dropped = [p.path for p in [*old, own] if p not in parts]
        spark.createDataFrame([([astuple(p) for p in parts], dropped)], f"parts {PARTS}, dropped array<string>") \
             .coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/meta/epoch={epoch}")
        remove(spark, self.folder, [*gone, *[f"meta/epoch={e}" for e in before[:-1]]])

    def read(self, spark: SparkSession) -> DataFrame:
        """The merged rows of all epochs."""
        have = numbered(spark, f"{self.folder}/meta")
        parts = self._manifest(spark, have[-1])[0] if have else []
        return self.table.merge(self.table.read(spark, self.folder, parts))


def sums(name: str, schema: str, keys: Sequence[str], values: Sequence[str]) -> Table:
    """A table of counts that add up by key."""
    return Table(name, schema, lambda d: d.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]))


def newest(name: str, schema: str, keys: Sequence[str], values: Sequence[str]) -> Table:
    """A table whose key takes the values of its newest epoch (an upsert)."""
    return Table(name, schema, lambda d: d.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_r")).select(*keys, "_r.*"))
