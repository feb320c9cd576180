"""Work and what is kept of it: once a key, caches that are checked, gates, path repair, groups by prefix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import AT, Scan


def once_a_key(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns of work(), which sees each distinct key once; list the question only if work depends on it."""
    return rows.join(work(rows.select(*keys).distinct()), keys, "left")


def with_cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (video, model, total) with the embeddings of a cache table of these keys; null is to be computed.

    An entry counts only for the same model and total, and only if it's whole: as many vectors as the total.
    """
    whole = cache.where(F.size("embeddings") == F.col("total")).groupBy("video", "model", "total").agg(F.max_by("embeddings", "written").alias("embeddings"))
    return wanted.join(whole, ["video", "model", "total"], "left")


def gated(calls: DataFrame, by: list[str], at: str, order: str, gap: float, parts: int | None = None) -> DataFrame:
    """calls with `start`: when each may go, in order, no sooner than asked for and `gap` after the one before.

    start(i) = max over j <= i of at(j) + gap * (i - j): a running maximum of at(j) - gap * j, no loop over calls. Within
    a part, places in the part serve as j; the maximum of earlier parts comes in places of the whole key.
    """
    scan = Scan(calls, by, [order], parts)
    slack = F.col(at) - F.lit(gap) * F.col(AT)
    states = scan.states(scan.rows, _n=F.count("*"), _first=F.min(AT), _top=F.max(slack))
    before = F.coalesce(F.sum("_n").over(scan.parts_before), F.lit(0))
    shift = F.lit(gap) * (F.col("_first") - before)
    states = states.withColumn("_shift", shift).withColumn("_whole", F.col("_top") + shift)
    rows = scan.carried(scan.rows, states, _carry=F.max("_whole").over(scan.parts_before) - F.col("_shift"))
    return scan.done(rows.withColumn("start", F.greatest(F.max(slack).over(scan.running), "_carry") + F.lit(gap) * F.col(AT)), "_carry")


def repaired_paths(rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """rows with the file of their path, else of the path whose parts end in no blanks; null if neither is there.

    A file that is listed twice is one file.
    """
    files = files.select("file").distinct()
    plain = F.rtrim(F.regexp_replace(F.col(path), r" +/", "/"))
    exact = files.select(F.col("file").alias("_f"))
    trimmed = files.select(F.col("file").alias("_g"))
    out = rows.join(exact, F.col(path) == F.col("_f"), "left").join(trimmed, plain == F.col("_g"), "left")
    return out.withColumn("file", F.coalesce("_f", "_g")).drop("_f", "_g")


def prefix_group(name: Column, prefixes: list[str], other: str = "other") -> Column:
    """The first of the prefixes that a name starts with."""
    return F.coalesce(*(F.when(F.startswith(name, F.lit(p)), p) for p in prefixes), F.lit(other))


def by_prefix(rows: DataFrame, name: str, size: str, prefixes: list[str]) -> DataFrame:
    """Entries and their size by group of names, as a checkpoint's tensors by module."""
    return rows.groupBy(prefix_group(F.col(name), prefixes).alias("part")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("size"))
