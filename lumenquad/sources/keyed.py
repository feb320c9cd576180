"""A cache that fills itself: one entry a key, computed where none is complete, kept as versions of a table.

Entries are only ever added: a fill appends what it computed, and of a key's entries the last complete one counts, so a
broken entry or a write that was never published leaves the old one in place. Two fills at once both stay; their common
keys are computed twice and the later counts. After `most` appends the table is written anew with one entry a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import ConflictError, VersionedTable


@dataclass
class Filled:
    rows: DataFrame
    #: How many entries this fill had to compute.
    computed: int


class KeyedCache:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], complete: Column, most: int = 16):
        """complete: whether an entry is whole, as a condition on its columns."""
        self.table, self.keys, self.complete, self.most = VersionedTable(spark, path), keys, complete, most

    def entries(self) -> DataFrame | None:
        """The last complete entry of each key; None before the first fill."""
        now = self.table.current()
        if now is None:
            return None
        rows = self.table.read(now)
        values = [c for c in rows.columns if c not in self.keys]
        aged = rows.where(self.complete).withColumn("_age", self.table.age(now))
        last = aged.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col("_age")).alias("_entry"))
        return last.select(*self.keys, "_entry.*")

    def upsert(self, entries: DataFrame) -> int:
        folder, rows = self.table.put(entries)
        if not rows:
            self.table.drop(folder)
            return 0
        done = self.table.append(folder, rows)
        if len(done.folders) > self.most:
            self.compact()
        return rows

    def compact(self) -> None:
        base = self.table.current()
        folder, rows = self.table.put(self.entries())
        try:
            self.table.replace(folder, rows, base)
        except ConflictError:  # somebody added entries meanwhile: the next one does it
            self.table.drop(folder)
            return
        self.table.vacuum()

    def filled(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> Filled:
        """wanted with its entries. compute gets the distinct keys that have none, and is evaluated once.

        Keys that it returns no complete entry for stay null and are asked for again the next time.
        """
        have = self.entries()
        keys = wanted.select(*self.keys).where(" and ".join(f"{k} is not null" for k in self.keys)).distinct()
        missing = keys if have is None else keys.join(have.select(*self.keys), self.keys, "left_anti")
        computed = 0 if missing.isEmpty() else self.upsert(compute(missing))
        have = self.entries()
        if have is None:
            return Filled(wanted, computed)
        return Filled(wanted.join(have, self.keys, "left"), computed)
