"""Keyed look-ups: with fallback keys, presence flags, resume, alignment, fill-in of cited values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import ranking


def with_selection(rows: DataFrame, selections: DataFrame) -> DataFrame:
    """rows with indices and scales of their frozen selection, by item index, else by path; null if neither is there.

    selections: key, indices, scales - one row a key.
    """
    by_index = selections.select(F.col("key").alias("_k1"), F.col("indices").alias("_i1"), F.col("scales").alias("_s1"))
    by_path = selections.select(F.col("key").alias("_k2"), F.col("indices").alias("_i2"), F.col("scales").alias("_s2"))
    out = rows.join(by_index, F.col("index").cast("string") == F.col("_k1"), "left").join(by_path, F.col("video_path") == F.col("_k2"), "left")
    hit = F.col("_k1").isNotNull()
    return out.withColumn("indices", F.when(hit, F.col("_i1")).otherwise(F.col("_i2"))).withColumn("scales", F.when(hit, F.col("_s1")).otherwise(F.col("_s2"))).drop("_k1", "_k2", "_i1", "_i2", "_s1", "_s2")


def by_path_or_name(rows: DataFrame, entries: DataFrame, path: str, key: str, value: str, order: str) -> DataFrame:
    """rows with `value` of the entry whose key is the path (the first by `order`, if several), else of the first entry
    with its base name."""
    exact = entries.groupBy(F.col(key).alias("_k")).agg(F.min_by(value, order).alias("_v"))
    names = entries.groupBy(text.base_name(F.col(key)).alias("_b")).agg(F.min_by(value, order).alias("_w"))
    out = rows.join(exact, F.col(path) == F.col("_k"), "left").join(names, text.base_name(F.col(path)) == F.col("_b"), "left")
    return out.withColumn(value, F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col("_w"))).drop("_k", "_v", "_b", "_w")


def longest_prefix(names: DataFrame, name: str, tokens: DataFrame, token: str) -> DataFrame:
    """names (distinct values of a column) with the columns of the longest token each starts with, alone or before an
    underscore; names without one are left out.

    A name's own beginnings are looked up, so the list of tokens may be of any length; a token listed twice counts once.
    """
    rest = [c for c in tokens.columns if c != token]
    one = tokens.groupBy(F.col(token).alias("_p")).agg(*(F.min_by(c, F.struct(*rest)).alias(c) for c in rest))
    tried = names.select(name).distinct().select(name, F.explode(text.token_prefixes(F.col(name))).alias("_p"))
    best = tried.join(one, "_p").groupBy(name).agg(F.max_by(F.struct(F.col("_p").alias(token), *rest), F.length("_p")).alias("_r"))
    return best.select(name, "_r.*")


def runs_of(files: DataFrame, subjects: DataFrame, datasets: DataFrame) -> DataFrame:
    """files (column file) with subject, folder, dataset and prefix of each prediction file's name; others are left out.

    subjects: token, folder - names and aliases of models, the longest that fits counts. datasets: token, dataset - what
    may stand behind it. prefix: what stands before the cell, an arm's ending apart. A file listed twice stays two rows.
    """
    stem = F.regexp_replace(text.base_name(F.col("file")), r"\.json$", "")
    rows = files.withColumn("_stem", stem)
    found = longest_prefix(rows, "_stem", subjects.select(F.col("token").alias("subject"), "folder"), "subject")
    behind = F.split_part(F.ltrim(F.substring("_stem", F.length("subject") + 1, F.length("_stem")), F.lit("_")), F.lit("_"), F.lit(1))
    known = datasets.groupBy("token").agg(F.min("dataset").alias("dataset"))
    found = found.withColumn("token", behind).join(known, "token").drop("token")
    return rows.join(found.withColumn("prefix", F.regexp_replace(text.without_ablation(F.col("_stem")), text.CELL, "")), "_stem").drop("_stem")


def flagged(rows: DataFrame, index: DataFrame, key: str, flag: str = "present") -> DataFrame:
    """rows with whether their key is in the index (any number of times)."""
    return rows.join(index.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def done_rows(previous: DataFrame) -> DataFrame:
    """Rows of an earlier run that need no second call: some output and no error (a run without errors has no column)."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return previous.where(filled("model_output") & ~filled("error") if "error" in previous.columns else filled("model_output"))


def to_do(items: DataFrame, previous: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items whose index and path no finished row has."""
    keys = keys or ["index", "video_path"]
    return items.join(done_rows(previous).select(*keys).distinct(), keys, "left_anti")


def merged_results(previous: DataFrame, fresh: DataFrame, key: str = "index") -> DataFrame:
    """Finished rows and new ones; a new row takes the place of an old one."""
    return fresh.unionByName(previous.join(fresh.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' rows by key, null where one side has none."""
    return a.join(b, keys, "full_outer")


def filled(measured: DataFrame, cited: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cited values where nothing was measured, with where each value comes from."""
    c = cited.select(F.col(key), *(F.col(x).alias(f"_{x}") for x in columns))
    out = measured.join(c, key, "left")
    for x in columns:
        source = F.when(F.col(x).isNotNull(), "measured").when(F.col(f"_{x}").isNotNull(), "cited")
        out = out.withColumn(f"{x}_source", source).withColumn(x, F.coalesce(x, f"_{x}")).drop(f"_{x}")
    return out


def missing_of(wanted: Column, have: Column, most: int = 5) -> Column:
    """The first few wanted numbers that a store lacks."""
    return F.slice(F.array_sort(F.array_except(wanted, have)), 1, most)


def missing_cells(rows: DataFrame, axes: list[str], present: DataFrame) -> DataFrame:
    """Cells of the grid of the axes' values that aren't present. Axes are dimensions of few values."""
    grid = rows.agg(*(F.collect_set(a).alias(a) for a in axes))
    for a in axes:
        grid = grid.withColumn(a, F.explode(a))
    return grid.join(present, axes, "left_anti")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolved(rows: DataFrame, local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """rows with the path of a local copy, else of a remote one, and which it is. local, remote: key, path."""
    out = rows.join(local.select(key, F.col("path").alias("_l")), key, "left").join(remote.select(key, F.col("path").alias("_r")), key, "left")
    origin = F.when(F.col("_l").isNotNull(), "local").when(F.col("_r").isNotNull(), "remote")
    return out.withColumn("path", F.coalesce("_l", "_r")).withColumn("origin", origin).drop("_l", "_r")


def templated(rows: DataFrame, templates: DataFrame, name: str = "template", slot: str = "{question}") -> DataFrame:
    """rows with the prompt of their template and its system text. templates: name, text, system."""
    t = templates.select(F.col("name").alias("_n"), F.col("text").alias("_t"), F.col("system").alias("_s"))
    out = rows.join(t, F.col(name) == F.col("_n"), "left")
    return out.withColumn("prompt", F.coalesce(F.replace("_t", F.lit(slot), F.col("question")), F.col("question"))).withColumn("system", F.coalesce("_s", F.lit(""))).drop("_n", "_t", "_s")


def by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables side by side, first to first; the longer one's rest drops out."""
    return ranking.dense_index(a, order_a, "_place").join(ranking.dense_index(b, order_b, "_place"), "_place").drop("_place")


def checked_size(rows: DataFrame, expected: int, what: str = "rows") -> DataFrame:
    """rows, or an error when they are not exactly as many as expected. Counts at once."""
    if (n := rows.count()) != expected:
        raise ValueError(f"expected {expected} {what}, got {n}")
    return rows
