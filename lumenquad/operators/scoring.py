"""Scoring: groups of four, confusion, multiple choice, paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, stats, text
from ..functions.pythonic import mcnemar_exact, nfkc, nfkc_each

ROLES = ["q0_i0", "q0_i1", "q1_i0", "q1_i1"]
KNOWN_TYPES = ["yes_no", "multiple_choice", "multiple_choice_4"]


def last_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def answered(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """index, pos, type and code of each prediction; null code where its item's type has none. Both sides by index.

    predictions: index, model_output, pos (order of the rows); items: index, type.
    """
    p = predictions.where("index is not null").select("index", "pos", "model_output").withColumn("norm", nfkc("model_output"))
    joined = p.join(items.select("index", "type"), "index", "left")
    blank = F.col("norm") == ""
    usable = F.col("type").isin(*KNOWN_TYPES)
    code = F.when(blank & F.col("type").isNotNull(), -1).when(usable, extract.answer(F.col("norm"), F.col("type")))
    return joined.select("index", "pos", "type", code.alias("code"))


def quads(codes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """instance_id and the four codes, from index, pos and code (null: unusable). One scan and one shuffle, by instance.

    Of rows with one index the last counts. An instance that lacks a role or has an unusable code is -1 throughout.
    carry: columns that come along from the row of the first role.
    """
    carry = carry or []
    keyed = codes.withColumn("instance_id", text.instance_id(F.col("index"))).withColumn("role", text.role(F.col("index")))
    picks = [F.max_by(F.coalesce("code", F.lit(-9)), F.when(F.col("role") == r, F.col("pos"))).alias(name) for r, name in enumerate(ROLES)]
    picks += [F.max_by(c, F.when(F.col("role") == 0, F.col("pos"))).alias(c) for c in carry]
    got = keyed.groupBy("instance_id").agg(*picks)
    whole = F.lit(True)
    for name in ROLES:
        whole = whole & F.coalesce(F.col(name) >= -1, F.lit(False))
    return got.select("instance_id", *(F.when(whole, F.col(n)).otherwise(-1).cast("int").alias(n) for n in ROLES), *carry)


def hits(one: str = "q0_i0", two: str = "q0_i1", three: str = "q1_i0", four: str = "q1_i1") -> dict[str, Column]:
    """How many of 4 answers, 2 questions, 2 videos and 1 instance are right; the gold of the roles is 1, 0, 0, 1."""
    a, b, c, d = F.col(one) == 1, F.col(two) == 0, F.col(three) == 0, F.col(four) == 1
    n = lambda x: x.cast("int")
    return {"items": n(a) + n(b) + n(c) + n(d), "questions": n(a & b) + n(d & c), "videos": n(a & c) + n(d & b), "instances": n(a & b & c & d)}


def quad_rates(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_instances, the counts, and Acc, Q_Acc, V_Acc, I_Acc (0 to 1) over all or by columns."""
    h = hits()
    got = scored.groupBy(*(by or [])).agg(F.count("*").alias("n_instances"), *(F.sum(v).cast("long").alias(f"n_{k}_right") for k, v in h.items()))
    n = F.col("n_instances")
    return (
        got.withColumn("Acc", stats.ratio(F.col("n_items_right"), 4 * n))
        .withColumn("Q_Acc", stats.ratio(F.col("n_questions_right"), 2 * n))
        .withColumn("V_Acc", stats.ratio(F.col("n_videos_right"), 2 * n))
        .withColumn("I_Acc", stats.ratio(F.col("n_instances_right"), n))
    )


def confusion(rows: DataFrame, gold: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """TP, FP, FN, TN, invalid, and rates over what could be read; codes 1, 0, -1."""
    valid = said.isin(0, 1)
    cell = lambda g, s: F.count_if(valid & (gold == 1 if g else gold != 1) & (said == s))
    got = rows.groupBy(*(by or [])).agg(cell(1, 1).alias("TP"), cell(0, 1).alias("FP"), cell(1, 0).alias("FN"), cell(0, 0).alias("TN"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    prf = stats.precision_recall(tp, fp, fn)
    return (
        got.withColumn("n_yesno_valid", tp + fp + fn + tn)
        .withColumn("n_yesno_total", tp + fp + fn + tn + F.col("invalid"))
        .withColumn("Acc", stats.ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", prf["precision"])
        .withColumn("recall", prf["recall"])
        .withColumn("F1", prf["f1"])
        .withColumn("yes_rate", stats.ratio(tp + fp, tp + fp + fn + tn))
    )


def mcq_coded(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions of four-way items with gold and choice codes (0 to 3, -1); items come once an index."""
    joined = predictions.select("index", "model_output").join(items, "index").withColumns({"norm": nfkc("model_output"), "options": nfkc_each("options"), "_gold": nfkc("answer")})
    code = F.when(F.col("norm") == "", -1).otherwise(extract.choice(F.col("norm"), F.col("options")))
    return joined.withColumn("gold_code", extract.gold_letter(F.col("_gold"))).withColumn("code", code).drop("norm", "_gold")


def mcq_scores(coded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, correct, invalid, histograms of gold and choice, majority baseline and interval; unread replies are wrong."""
    gold, code = F.col("gold_code"), F.col("code")
    letters = "ABCD"
    got = coded.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(extract.item_correct(code, gold)).alias("correct"),
        F.count_if(code < 0).alias("invalid"),
        *(F.count_if(gold == i).alias(f"gold_{x}") for i, x in enumerate(letters)),
        *(F.count_if(code == i).alias(f"chosen_{x}") for i, x in enumerate(letters)),
    )
    most = F.greatest(*(F.col(f"gold_{x}") for x in letters))
    first = F.coalesce(*(F.when(F.col(f"gold_{x}") == most, x) for x in letters))
    ci = stats.wilson(F.col("correct"), F.col("n"), clamp=True)
    return (
        got.withColumn("Acc_pct", 100 * stats.ratio(F.col("correct"), F.col("n")))
        .withColumn("majority_pct", 100 * stats.ratio(most, F.col("n")))
        .withColumn("majority_letter", first)
        .withColumn("Acc_lo", ci["lo"])
        .withColumn("Acc_hi", ci["hi"])
    )


def mcq_by_group(coded: DataFrame, groups: list[str]) -> DataFrame:
    """One pass for the whole and each single grouping: grouping, value, n, correct, Acc_pct; blank values drop out."""
    clean = coded.select(extract.item_correct(F.col("code"), F.col("gold_code")).cast("long").alias("ok"), *(F.nullif(F.col(g), F.lit("")).alias(g) for g in groups))
    sets = [[], *[[F.col(g)] for g in groups]]
    got = clean.groupingSets(sets, *(F.col(g) for g in groups)).agg(F.count("*").alias("n"), F.sum("ok").cast("long").alias("correct"), F.grouping_id().alias("_g"))
    out = None
    for i, g in enumerate(groups):
        mine = (1 << len(groups)) - 1 - (1 << (len(groups) - 1 - i))
        out = F.when(F.col("_g") == mine, F.lit(g)) if out is None else out.when(F.col("_g") == mine, F.lit(g))
    got = got.withColumn("grouping", out.otherwise(F.lit("all"))).withColumn("value", F.coalesce(*groups))
    return got.where((F.col("grouping") == "all") | F.col("value").isNotNull()).select("grouping", "value", "n", "correct", (100 * stats.ratio(F.col("correct"), F.col("n"))).alias("Acc_pct"))


def paired(a: DataFrame, b: DataFrame, key: str, right: str = "right") -> DataFrame:
    """Exact paired test of two runs on shared keys: counts of both, either and neither right, and the p value."""
    both = a.select(key, F.col(right).cast("boolean").alias("_a")).join(b.select(key, F.col(right).cast("boolean").alias("_b")), key)
    got = both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_a") & F.col("_b")).alias("both"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"),
        F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"),
        F.count_if(~F.col("_a") & ~F.col("_b")).alias("neither"),
    )
    return got.withColumn("p_value", mcnemar_exact("only_a", "only_b"))


def strict_instances(rows: DataFrame, by: list[str]) -> DataFrame:
    """I_Acc and Acc (percent) over instances, right if all their rows are; category of an instance: of its first row.

    rows: by columns, instance_id, index, correct (0 or 1), category.
    """
    inst = rows.groupBy(*by, "instance_id").agg(F.bool_and(F.col("correct") == 1).alias("all_right"), F.sum("correct").alias("right"), F.count("*").alias("items"), F.min_by("category", "index").alias("category"))
    return inst


def instance_table(inst: DataFrame, by: list[str]) -> DataFrame:
    got = inst.groupBy(*by).agg(F.count("*").alias("n_instances"), F.count_if("all_right").alias("n_right"), F.sum("right").cast("long").alias("items_right"), F.sum("items").cast("long").alias("n_items"))
    return got.withColumn("I_Acc", 100 * stats.ratio(F.col("n_right"), F.col("n_instances"))).withColumn("Acc", 100 * stats.ratio(F.col("items_right"), F.col("n_items")))
