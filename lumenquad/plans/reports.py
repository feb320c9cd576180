"""From predictions to fact rows, sweeps, leaderboards, ablations and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, stats, text
from ..functions.pythonic import nfkc, nfkc_each
from ..operators import joins, ranking, scoring
from ..schemas import CHANCE, TABLE_BUDGETS


def fact_rows(predictions: DataFrame, truth: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """Per-question rows of all cells: key join, extraction by type, label, strict verdict, frozen selection.

    predictions: sampler, num_frames, ablation, pred_file, index, video_path, model_output, error; truth: an answer key.
    """
    t = truth.select("index", F.col("video_path").alias("_path"), F.col("question").alias("_question"), F.col("answer").alias("gold"), "type", "options", "duration", "task_type")
    rows = predictions.where("index is not null").drop("question").join(t, "index")
    rows = rows.withColumns({"norm": nfkc("model_output"), "options": nfkc_each("options")})
    rows = rows.withColumn("code", extract.answer(F.col("norm"), F.col("type"), F.col("options"))).withColumn("extracted", extract.label(F.col("code"), F.col("type")))
    rows = rows.withColumn("correct", ((F.col("code") >= 0) & (F.col("extracted") == F.col("gold"))).cast("int"))
    rows = rows.withColumn("video_path", F.coalesce(F.nullif("video_path", F.lit("")), "_path"))
    out = rows.select(
        F.col("sampler").alias("strategy"), F.col("num_frames").alias("nframes"), "ablation", "index",
        F.when(F.col("type") != "mcq4", text.instance_id(F.col("index"))).alias("instance_id"), "video_path", F.col("_question").alias("question"), "gold",
        F.coalesce("model_output", F.lit("")).alias("model_output"), "extracted", "correct", F.coalesce("error", F.lit("")).alias("error"), "pred_file", "duration", "task_type", "type", "code",
    )
    if selections is None:
        return out
    # Selections differ by cell: the key carries it.
    keyed = selections.withColumn("key", F.concat_ws("|", "sampler", F.col("num_frames").cast("string"), "key"))
    cell = F.concat_ws("|", "strategy", F.col("nframes").cast("string"))
    by_index = keyed.select(F.col("key").alias("_k1"), F.col("indices").alias("_i1"), F.col("scales").alias("_s1"))
    by_path = keyed.select(F.col("key").alias("_k2"), F.col("indices").alias("_i2"), F.col("scales").alias("_s2"))
    out = out.join(by_index, F.concat_ws("|", cell, F.col("index").cast("string")) == F.col("_k1"), "left").join(by_path, F.concat_ws("|", cell, "video_path") == F.col("_k2"), "left")
    hit = F.col("_k1").isNotNull()
    return out.withColumn("frame_indices", F.when(hit, F.col("_i1")).otherwise(F.col("_i2"))).withColumn("f2c_scales", F.when(hit, F.col("_s1")).otherwise(F.col("_s2"))).drop("_k1", "_k2", "_i1", "_i2", "_s1", "_s2")


def checked_export(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """A combined export with gold, label and verdict derived anew, and whether what it held differs from the key."""
    t = truth.select("index", F.col("video_path").alias("_path"), F.col("answer").alias("_gold"), "type", "options")
    both = rows.join(t, "index", "left").withColumns({"norm": nfkc("model_output"), "options": nfkc_each("options")})
    code = extract.answer(F.col("norm"), F.coalesce("type", F.lit("yes_no")), F.col("options"))
    known = F.col("_gold").isNotNull()
    both = both.withColumn("mismatch", known & ((F.lower(F.trim("gold")) != F.col("_gold")) | ~F.col("video_path").eqNullSafe(F.col("_path"))))
    both = both.withColumn("extracted", F.when(known, extract.label(code, F.col("type"))).otherwise(F.col("extracted")))
    both = both.withColumn("gold", F.coalesce("_gold", "gold")).withColumn("video_path", F.when(known, F.col("_path")).otherwise(F.col("video_path")))
    return both.withColumn("correct", F.when(known, ((F.col("extracted") != "") & (F.col("extracted") == F.col("gold"))).cast("int")).otherwise(F.col("correct"))).drop("_path", "_gold", "type", "options", "norm")


def cell_guard(rows: DataFrame, by: list[str], expected: int) -> DataFrame:
    """Rows of cells that have exactly the expected number of rows."""
    whole = rows.groupBy(*by).count().where(F.col("count") == expected).drop("count")
    return rows.join(whole, by, "left_semi")


def quad_metrics(facts: DataFrame, by: list[str]) -> DataFrame:
    """Rates and confusion of each cell of groups of four; rates over all items, confusion over yes/no items."""
    w = facts.withColumn("pos", F.monotonically_increasing_id())
    keyed = w.withColumn("role", text.role(F.col("index")))
    picks = [F.max_by("code", F.when(F.col("role") == r, F.col("pos"))).alias(n) for r, n in enumerate(scoring.ROLES)]
    inst = keyed.groupBy(*by, "instance_id").agg(*picks)
    whole = F.lit(True)
    for n in scoring.ROLES:
        whole = whole & F.col(n).isNotNull()
    inst = inst.select(*by, "instance_id", *(F.when(whole, F.col(n)).otherwise(-1).alias(n) for n in scoring.ROLES))
    rates = scoring.quad_rates(inst, by)
    gold = F.when(F.col("gold") == "yes", 1).otherwise(0)
    table = scoring.confusion(facts.where("type = 'yes_no'"), gold, F.col("code"), by)
    return rates.join(table.withColumnRenamed("Acc", "yesno_Acc"), by, "left")


def sweep_columns(metrics: DataFrame, n_items: Column, n_instances: Column, n_acc_items: Column) -> DataFrame:
    """A sweep table from metrics: percents, intervals and z values, unrounded; budgets of tables only.

    metrics: model, dataset, sampler, num_frames, I_Acc, Q_Acc, V_Acc, Acc (0 to 1), TP, FP, FN, TN, invalid.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    k = stats.count_of_percent(100 * F.col("I_Acc"), n_instances)
    wilson, j = stats.wilson(k, n_instances), stats.youden(tp, fp, fn, tn)
    rows = metrics.where(F.col("num_frames").isin(*TABLE_BUDGETS))
    return rows.select(
        "model", "dataset", "sampler", "num_frames", n_items.cast("long").alias("n_items"), n_instances.cast("long").alias("n_instances"),
        (100 * F.col("I_Acc")).alias("I_Acc"), wilson["lo"].alias("I_Acc_lo"), wilson["hi"].alias("I_Acc_hi"),
        (100 * F.col("Q_Acc")).alias("Q_Acc"), (100 * F.col("V_Acc")).alias("V_Acc"), (100 * F.col("Acc")).alias("Acc"),
        (100 * stats.ratio(tp + fp, tp + fp + fn + tn)).alias("yes_rate"), "TP", "FP", "FN", "TN", "invalid",
        stats.sensitivity(tp, fn).alias("sensitivity"), stats.specificity(tn, fp).alias("specificity"), j["j"].alias("youden_J"), j["lo"].alias("J_lo"), j["hi"].alias("J_hi"),
        stats.z_against(k, n_instances, CHANCE["I_Acc"] / 100).alias("z_I_Acc_vs_chance"),
        stats.z_against(stats.count_of_percent(100 * F.col("Acc"), n_acc_items), n_acc_items, CHANCE["Acc"] / 100).alias("z_Acc_vs_chance"),
    )


def mcq_sweep(scores: DataFrame, by_duration: DataFrame, keys: list[str]) -> DataFrame:
    """A four-way sweep table: overall scores and a column of accuracy for each duration."""
    wide = by_duration.groupBy(*keys).agg(*(F.max(F.when(F.col("duration") == d, F.col("Acc_pct"))).alias(f"{d}_Acc") for d in ("short", "medium", "long")))
    return scores.join(wide, keys, "left").withColumn("chance", F.lit(CHANCE["mcq4"]))


def leaderboard(cells: DataFrame, others: list[tuple[DataFrame, list[str]]], cited: DataFrame | None, key: str = "model") -> DataFrame:
    """Each model's best cell beside its results on other benchmarks; cited values where none was measured."""
    out = ranking.best_cell(cells, [key])
    columns = []
    for table, names in others:
        out = out.join(table.select(key, *names), key, "left")
        columns += names
    return joins.filled(out, cited, key, columns) if cited is not None else out


ARMS = [("ordered", "none"), ("shuffled", "shuffled_frames"), ("reversed", "reversed_frames"), ("no-video", "no_video")]


def order_ablation(instances: DataFrame, by: list[str], sampler: str = "uniform", num_frames: int = 16) -> DataFrame:
    """I_Acc and Acc of the order probes at one budget; the arm without video has no budget."""
    arm = F.lit(None).cast("string")
    for name, ablation in ARMS:
        at = F.col("ablation") == ablation
        arm = F.when(at if ablation == "no_video" else at & (F.col("strategy") == sampler) & (F.col("nframes") == num_frames), name).otherwise(arm)
    return scoring.instance_table(instances.withColumn("arm", arm).where("arm is not null"), [*by, "arm"]).withColumn("arm_rank", ranking.rank_of(F.col("arm"), [a for a, _ in ARMS]))


def by_category(instances: DataFrame, by: list[str]) -> DataFrame:
    return scoring.instance_table(instances.where("category is not null"), [*by, "category"])


def series(cells: DataFrame, row: list[str], column: str, values: list, metric: str) -> DataFrame:
    """A chart's series: one column for each value, by conditional aggregates."""
    return cells.groupBy(*row).agg(*(F.max(F.when(F.col(column) == v, F.col(metric))).alias(f"{metric}_{v}") for v in values))


def long_form(wide: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def stacked(tables: list[DataFrame], names: DataFrame, order: list[Column]) -> DataFrame:
    """Sweep tables under one another, models by their display names, in order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    shown = out.join(names, "model", "left")
    return shown.withColumn("model", F.coalesce("display", "model")).drop("display").orderBy(*order)


def best_marks(table: DataFrame, group: str, excluded: str, columns: list[str]) -> DataFrame:
    """Whether each value is its column's best outside one group. The best values, one row, are found at once."""
    best = table.where(F.col(group) != excluded).agg(*(F.max(c).alias(c) for c in columns)).first()
    return table.select(*table.columns, *((F.abs(F.col(c) - F.lit(best[c])) < 1e-9).alias(f"{c}_best") for c in columns))


def prepared_mcq(raw: DataFrame, durations: list[str], index: DataFrame | None = None, most_videos: int | None = None, require_video: bool = False) -> DataFrame:
    """Four-way items from a raw dump: durations wanted (blank passes), rows with an id, the first videos only if
    capped, missing ones marked or dropped, four options each or an error, numbered anew."""
    duration = F.lower(F.trim(F.coalesce("duration", F.lit(""))))
    rows = raw.withColumn("duration", duration).where((F.col("duration") == "") | F.col("duration").isin(*durations)).where(F.coalesce("video_id", F.lit("")) != "")
    if most_videos is not None:
        rows = ranking.first_distinct(rows, "video_id", "pos", most_videos)
    if index is not None:
        rows = joins.flagged(rows, index, "video_id")
        rows = rows.where("present") if require_video else rows
    checked = F.when(F.size("options") == 4, F.col("options")).otherwise(F.raise_error(F.concat(F.lit("expected 4 options: "), F.coalesce("question_id", F.lit("?")))).cast("array<string>"))
    rows = rows.withColumn("options", checked).withColumn("answer", F.trim(F.coalesce("answer", F.lit("")))).withColumn("type", F.lit("mcq4"))
    return ranking.dense_index(rows.withColumn("video_path", F.concat(F.lit("videos/"), F.col("video_id"), F.lit(".mp4"))), "pos")


def report_text(metrics: DataFrame) -> DataFrame:
    """Console lines of a confusion table."""
    line = F.format_string("TP=%d FP=%d FN=%d TN=%d invalid=%d", "TP", "FP", "FN", "TN", "invalid")
    return metrics.withColumn("report", F.concat_ws("\n", line, F.when((F.col("Acc") < 0.4) | (F.col("Acc") > 0.6), F.lit("yes/no accuracy lies outside 40 to 60 percent")).otherwise(F.lit("yes/no accuracy near chance"))))


def makeup(items: DataFrame, category: str = "category") -> DataFrame:
    """Instances, distinct clips and items of each category."""
    return items.groupBy(category).agg(F.countDistinct(text.instance_id(F.col("index"))).alias("n_instances"), F.countDistinct("video_path").alias("n_clips"), F.count("*").alias("n_items"))


def spending(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and cost of each group, and how many failed."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.sum("tokens").cast("long").alias("tokens"), F.sum("cost").alias("cost"), F.count_if(F.coalesce(F.trim("error"), F.lit("")) != "").alias("n_failed"))
