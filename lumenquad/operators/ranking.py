"""Orders, best cells, prefixes and dense numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SAMPLERS, TIE_RANK
from ..sources import staging
from .scans import AT, Scan


def rank_of(value: Column, order: list[str], other: int = 99) -> Column:
    """Place of a value in a list, `other` for one that isn't in it."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(other).cast("int")


def sampler_rank(sampler: Column) -> Column:
    return rank_of(sampler, SAMPLERS)


def best_cell(cells: DataFrame, by: list[str], metric: str = "I_Acc", other: str = "Acc") -> DataFrame:
    """Best cell by the metric (ties: plainest sampler, then largest budget) and, apart from it, by the other metric.

    cells: by columns, sampler, num_frames, both metrics.
    """
    tie = F.create_map(*(F.lit(x) for kv in TIE_RANK.items() for x in kv))
    plain = F.coalesce(F.try_element_at(tie, F.col("sampler")), F.lit(9))
    order = lambda m: F.struct(F.col(m), (-plain).alias("r"), F.col("num_frames"))
    cell = F.struct("sampler", "num_frames", metric)
    got = cells.groupBy(*by).agg(F.max_by(cell, order(metric)).alias("b"), F.max_by(F.struct("sampler", "num_frames", other), order(other)).alias("o"))
    name = lambda s: F.concat(s["sampler"], F.lit("-"), s["num_frames"].cast("string"))
    return got.select(*by, F.col("b")[metric].alias(metric), F.col("o")[other].alias(other), name(F.col("b")).alias("config"), name(F.col("o")).alias(f"{other}_config"))


def first_distinct(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Rows of the first `most` distinct keys in order of appearance. Keys, not rows, are ranked."""
    keys = rows.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first").limit(most).select(key)
    return rows.join(keys, key, "left_semi")


def dense_index(rows: DataFrame, order: str, name: str = "index") -> DataFrame:
    """0, 1, 2, ... in order: counts by range and an offset for each, so no task sees all rows.

    The ranged rows are written once, with their part and place there: both sides of the join must see the same parts,
    which two runs of one adaptive shuffle don't promise. The offsets are one row a part.
    """
    spread = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    marked = spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    marked = staging.written(marked, staging.new_path(rows.sparkSession, "numbered"))
    counts = marked.groupBy("_part").agg(F.max("_at").alias("_last"))
    before = F.sum(F.col("_last") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return marked.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def finished_prefix(rows: DataFrame, position: str, done: str) -> DataFrame:
    """Rows before the first one that isn't done. The gap is found at once, so the scan can skip what lies behind it."""
    gap = rows.agg(F.min(F.when(~F.col(done), F.col(position)))).first()[0]
    return rows if gap is None else rows.where(F.col(position) < gap)


def running_mean(rows: DataFrame, by: list[str], order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Mean of the values up to each row of its key, over range parts; null before the first value."""
    scan = Scan(rows, by, [order], parts)
    out = scan.running_sum(scan.running_sum(scan.rows, F.col(value).cast("double"), "_sum"), F.col(value).isNotNull().cast("long"), "_n")
    return scan.done(out.withColumn(name, F.try_divide("_sum", "_n")), "_sum", "_n")


def next_distinct(rows: DataFrame, by: str, key: str, order: str, ahead: int, parts: int | None = None) -> DataFrame:
    """For each new key in order, within `by`: the next few new keys.

    A part's first few keys are its boundary record: those of the parts behind fill up what a part's last rows lack.
    """
    firsts = rows.groupBy(by, key).agg(F.min(order).alias("_o"))
    scan = Scan(firsts, [by], ["_o"], parts)
    heads = scan.rows.withColumn("_place", F.row_number().over(scan.local)).where(F.col("_place") <= ahead)
    states = scan.states(heads, _head=F.transform(F.array_sort(F.collect_list(F.struct(AT, key))), lambda x: x[key]))
    behind = F.slice(F.flatten(F.collect_list("_head").over(scan.neighbours.rowsBetween(1, ahead))), 1, ahead)
    own = F.collect_list(key).over(scan.local.rowsBetween(1, ahead))
    out = scan.carried(scan.rows.withColumn("_own", own), states, _behind=behind)
    return out.select(by, key, F.col("_o").alias("first_at"), F.slice(F.concat("_own", F.coalesce("_behind", F.slice("_own", 1, 0))), 1, ahead).alias("next_keys"))
