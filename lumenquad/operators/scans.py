"""Prefix scans over range parts: running values of keys that are too long for one task.

Rows are dealt to ranges of (key, order) and written once with their part, so one key may lie in many parts. A window
runs within key and part; what a row needs from the parts before or behind (a sum, a maximum, the nearest row) comes from
one state a key and part. Only keys that go over a border need one, and a border has one such key, so states are at most
two a part and go to all tasks. Rows with equal order lie in one part. Null keys are a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources import staging

PART, AT = "_part", "_at"


class Scan:
    """rows in parts: `rows` has the part and a place in it, ascending in order. parts: how many, by Spark's own sizes if
    not given."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str], parts: int | None = None):
        self.by = by
        keys = [F.col(c) for c in (*by, *order)]
        ranged = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        marked = ranged.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id() % (1 << 33))
        self.rows = staging.written(marked, staging.new_path(rows.sparkSession, "scan"))

    @property
    def local(self) -> WindowSpec:
        """A key's rows in a part."""
        return Window.partitionBy(*self.by, PART).orderBy(AT)

    @property
    def running(self) -> WindowSpec:
        return self.local.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def parts_before(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def neighbours(self) -> WindowSpec:
        """A key's parts in order, without a frame: for lag, lead and frames of one's own."""
        return Window.partitionBy(*self.by).orderBy(PART)

    def states(self, rows: DataFrame, **states: Column) -> DataFrame:
        """Aggregates by key and part of the keys that lie in several parts. rows: those of this scan, with more columns."""
        found = rows.groupBy(*self.by, PART).agg(*(c.alias(n) for n, c in states.items()))
        several = F.count("*").over(Window.partitionBy(*self.by))
        return found.withColumn("_parts", several).where("_parts > 1").drop("_parts")

    def carried(self, rows: DataFrame, states: DataFrame, **carry: Column) -> DataFrame:
        """rows with what the states give their part, null for keys of one part."""
        named = states.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate((*self.by, PART))), *(c.alias(n) for n, c in carry.items()))
        same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate((*self.by, PART))]
        condition = same[0]
        for c in same[1:]:
            condition &= c
        # At most two rows a part, whatever the keys: see above.
        return rows.join(F.broadcast(named), condition, "left").drop(*(f"_by{i}" for i in range(len(same))))

    def done(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.drop(PART, AT, *more)

    def with_neighbours(self, column: str, before: str, behind: str) -> DataFrame:
        """rows with the column's value in the row before and in the one behind, null where there is none."""
        states = self.states(self.rows, _first=F.min_by(F.struct(column), AT), _last=F.max_by(F.struct(column), AT))
        rows = self.carried(self.rows, states, _left=F.lag("_last").over(self.neighbours), _right=F.lead("_first").over(self.neighbours))
        # A struct tells a null value from no row.
        cell = F.struct(column)
        sides = {before: F.coalesce(F.lag(cell).over(self.local), F.col("_left")), behind: F.coalesce(F.lead(cell).over(self.local), F.col("_right"))}
        return rows.withColumns({n: c[column] for n, c in sides.items()}).drop("_left", "_right")

    def running_sum(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with the sum of a value over their key up to them. rows: those of this scan, with more columns."""
        rows = rows.withColumn("_value", value)
        rows = self.carried(rows, self.states(rows, _sum=F.sum("_value")), _before=F.sum("_sum").over(self.parts_before))
        return rows.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.sum("_value").over(self.running), F.lit(0))).drop("_value", "_before")

