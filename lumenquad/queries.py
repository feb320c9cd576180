"""Each operator as a query over the shared tables, with equivalent SQL wherever SQL can express it.

The tables stand in for benchmark files: orders for items of four roles, labels for predictions, events for ordered
frames, line items for cells, pages and generated names for files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cost, extract, pythonic, sampling, stats, text
from .operators import joins, ranking, scoring, segments, vectors, work
from .plans import reports
from .schemas import CATEGORIES
from .sources import staging
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Query]:
    """Registers a function of a table reader under its name."""

    def register(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def six(c: Column) -> Column:
    return F.round(c, 6)


def names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- groups of four -------------------------------------------------------------------------------------------------

CODES = """SELECT o_orderkey AS idx, o_orderpriority, CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 5 = 0 THEN -1 WHEN CAST(floor(o_totalprice) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS code FROM orders"""
QUADS = f"""WITH c AS ({CODES}),
g AS (SELECT idx // 4 AS instance_id, max(o_orderpriority) FILTER (idx % 4 = 0) AS category, max(code) FILTER (idx % 4 = 0) AS a, max(code) FILTER (idx % 4 = 1) AS b, max(code) FILTER (idx % 4 = 2) AS c, max(code) FILTER (idx % 4 = 3) AS d, count(DISTINCT idx % 4) AS n FROM c GROUP BY 1),
q AS (SELECT instance_id, category, CASE WHEN n = 4 THEN a ELSE -1 END AS a, CASE WHEN n = 4 THEN b ELSE -1 END AS b, CASE WHEN n = 4 THEN c ELSE -1 END AS c, CASE WHEN n = 4 THEN d ELSE -1 END AS d FROM g),
h AS (SELECT *, CAST(a = 1 AS INT) + CAST(b = 0 AS INT) + CAST(c = 0 AS INT) + CAST(d = 1 AS INT) AS items, CAST(a = 1 AND b = 0 AS INT) + CAST(d = 1 AND c = 0 AS INT) AS questions, CAST(a = 1 AND c = 0 AS INT) + CAST(d = 1 AND b = 0 AS INT) AS videos, CAST(a = 1 AND b = 0 AND c = 0 AND d = 1 AS INT) AS instances FROM q)"""
RATES = """count(*) AS n_instances, CAST(sum(items) AS BIGINT) AS n_items_right, CAST(sum(questions) AS BIGINT) AS n_questions_right, CAST(sum(videos) AS BIGINT) AS n_videos_right, CAST(sum(instances) AS BIGINT) AS n_instances_right, round(sum(items) / (4.0 * count(*)), 6) AS Acc, round(sum(questions) / (2.0 * count(*)), 6) AS Q_Acc, round(sum(videos) / (2.0 * count(*)), 6) AS V_Acc, round(sum(instances) / (1.0 * count(*)), 6) AS I_Acc"""


def order_codes(t) -> DataFrame:
    price = F.floor("o_totalprice").cast("long")
    code = F.when(price % 5 == 0, -1).when(price % 2 == 0, 1).otherwise(0)
    return t("orders").select(F.col("o_orderkey").alias("index"), F.col("o_orderkey").alias("pos"), "o_orderpriority", code.alias("code"))


def order_quads(t) -> DataFrame:
    """Quads with the category of their first role."""
    return scoring.quads(order_codes(t), ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "category")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(F.col(c)) for c in columns})


WILSON = lambda k, n: (f"round(100 * (({k} / CAST({n} AS DOUBLE) + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({k} / CAST({n} AS DOUBLE) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})), 6)", f"round(100 * (({k} / CAST({n} AS DOUBLE) + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) + 1.96 * sqrt({k} / CAST({n} AS DOUBLE) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})), 6)")


@query(f"{QUADS} SELECT category, {RATES}, {WILSON('sum(instances)', 'count(*)')[0]} AS I_lo, {WILSON('sum(instances)', 'count(*)')[1]} AS I_hi FROM h GROUP BY category")
def quad_accuracy_by_category(t):
    got = scoring.quad_rates(order_quads(t), ["category"])
    ci = stats.wilson(F.col("n_instances_right"), F.col("n_instances"))
    return rounded(got.withColumn("I_lo", ci["lo"]).withColumn("I_hi", ci["hi"]), "Acc", "Q_Acc", "V_Acc", "I_Acc", "I_lo", "I_hi")


@query(f"{QUADS} SELECT {RATES} FROM h")
def quad_rates(t):
    return rounded(scoring.quad_rates(scoring.quads(order_codes(t))), "Acc", "Q_Acc", "V_Acc", "I_Acc")


@query(f"{QUADS} SELECT instance_id, a AS q0_i0, b AS q0_i1, c AS q1_i0, d AS q1_i1 FROM h")
def quad_answers(t):
    return scoring.quads(order_codes(t))


@query("""WITH g AS (SELECT doc_id // 4 AS instance_id, max(quality) FILTER (doc_id % 4 = 0) AS a, max(quality) FILTER (doc_id % 4 = 1) AS b, max(quality) FILTER (doc_id % 4 = 2) AS c, max(quality) FILTER (doc_id % 4 = 3) AS d, count(DISTINCT doc_id % 4) AS n FROM labels GROUP BY 1)
SELECT instance_id, CASE WHEN n = 4 THEN a ELSE -1 END AS q0_i0, CASE WHEN n = 4 THEN b ELSE -1 END AS q0_i1, CASE WHEN n = 4 THEN c ELSE -1 END AS q1_i0, CASE WHEN n = 4 THEN d ELSE -1 END AS q1_i1 FROM g""")
def quad_incomplete(t):
    return scoring.quads(t("labels").select(F.col("doc_id").alias("index"), F.col("doc_id").alias("pos"), F.col("quality").alias("code")))


@query("""WITH p AS (SELECT o_custkey AS idx, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) % 2 AS code FROM orders), l AS (SELECT idx, arg_max(code, pos) AS code FROM p GROUP BY idx),
g AS (SELECT idx // 4 AS instance_id, max(code) FILTER (idx % 4 = 0) AS a, max(code) FILTER (idx % 4 = 1) AS b, max(code) FILTER (idx % 4 = 2) AS c, max(code) FILTER (idx % 4 = 3) AS d, count(*) AS n FROM l GROUP BY 1)
SELECT instance_id, CAST(CASE WHEN n = 4 THEN a ELSE -1 END AS INT) AS q0_i0, CAST(CASE WHEN n = 4 THEN b ELSE -1 END AS INT) AS q0_i1, CAST(CASE WHEN n = 4 THEN c ELSE -1 END AS INT) AS q1_i0, CAST(CASE WHEN n = 4 THEN d ELSE -1 END AS INT) AS q1_i1 FROM g""")
def quad_last_answer_wins(t):
    p = t("orders").select(F.col("o_custkey").alias("index"), F.col("o_orderkey").alias("pos"), (F.floor("o_totalprice").cast("long") % 2).cast("int").alias("code"))
    return scoring.quads(p)


@query("SELECT CAST(o_orderkey - 100 AS BIGINT) AS idx, CAST(floor((o_orderkey - 100) / 4.0) AS BIGINT) AS instance_id, CAST(((o_orderkey - 100) % 4 + 4) % 4 AS INT) AS role FROM orders")
def quad_keys(t):
    i = F.col("o_orderkey") - 100
    return t("orders").select(i.alias("idx"), text.instance_id(i).alias("instance_id"), text.role(i).alias("role"))


@query(f"{QUADS}, s AS (SELECT category, instance_id, CAST(a = 1 AND b = 0 AND c = 0 AND d = 1 AS INT) AS ok, items FROM h) SELECT category, count(*) AS n_instances, CAST(sum(ok) AS BIGINT) AS n_right, CAST(sum(items) AS BIGINT) AS items_right, 4 * count(*) AS n_items, round(100.0 * sum(ok) / count(*), 6) AS I_Acc, round(100.0 * sum(items) / (4 * count(*)), 6) AS Acc FROM s GROUP BY category")
def strict_accuracy_by_category(t):
    c = order_codes(t)
    right = F.when(text.role(F.col("index")).isin(0, 3), F.col("code") == 1).otherwise(F.col("code") == 0).cast("int")
    rows = c.select(text.instance_id(F.col("index")).alias("instance_id"), "index", right.alias("correct"), F.col("o_orderpriority").alias("category"))
    return rounded(reports.by_category(scoring.strict_instances(rows, []), []), "I_Acc", "Acc")


# --- confusion and statistics ---------------------------------------------------------------------------------------

CONFUSION = """count(*) FILTER (g = 1 AND s = 1) AS TP, count(*) FILTER (g = 0 AND s = 1) AS FP, count(*) FILTER (g = 1 AND s = 0) AS FN, count(*) FILTER (g = 0 AND s = 0) AS TN, count(*) FILTER (s NOT IN (0, 1)) AS invalid"""
PREDICTED = "SELECT l.quality AS g, CASE WHEN l.doc_id % 11 = 0 THEN -1 ELSE 1 - l.toxic END AS s, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def label_predictions(t) -> DataFrame:
    l = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    return l.select(F.col("quality").alias("g"), F.when(F.col("doc_id") % 11 == 0, -1).otherwise(1 - F.col("toxic")).alias("s"), "lang", "doc_id")


@query(f"""WITH p AS ({PREDICTED}), c AS (SELECT lang, {CONFUSION} FROM p GROUP BY lang) SELECT lang, TP, FP, FN, TN, invalid, TP + FP + FN + TN AS n_yesno_valid, TP + FP + FN + TN + invalid AS n_yesno_total,
round(coalesce((TP + TN) / nullif(TP + FP + FN + TN, 0), 0), 6) AS Acc, round(coalesce(TP / nullif(TP + FP, 0), 0), 6) AS "precision", round(coalesce(TP / nullif(TP + FN, 0), 0), 6) AS recall, round(coalesce(2.0 * TP / nullif(2 * TP + FP + FN, 0), 0), 6) AS F1, round(coalesce((TP + FP) / nullif(TP + FP + FN + TN, 0), 0), 6) AS yes_rate FROM c""")
def confusion_by_language(t):
    return rounded(scoring.confusion(label_predictions(t), F.col("g"), F.col("s"), ["lang"]), "Acc", "precision", "recall", "F1", "yes_rate")


@query(f"""WITH p AS ({PREDICTED}), c AS (SELECT lang, {CONFUSION} FROM p GROUP BY lang), r AS (SELECT lang, 100.0 * TP / (TP + FN) AS sens, 100.0 * TN / (TN + FP) AS spec, TP + FN AS pos, TN + FP AS neg FROM c WHERE TP + FN > 0 AND TN + FP > 0), e AS (SELECT *, 100 * sqrt(sens / 100 * (1 - sens / 100) / pos + spec / 100 * (1 - spec / 100) / neg) AS se FROM r)
SELECT lang, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(sens + spec - 100, 6) AS youden_j, round(sens + spec - 100 - 1.96 * se, 6) AS j_lo, round(sens + spec - 100 + 1.96 * se, 6) AS j_hi FROM e""")
def youden_by_language(t):
    c = scoring.confusion(label_predictions(t), F.col("g"), F.col("s"), ["lang"]).where("TP + FN > 0 and TN + FP > 0")
    tp, fp, fn, tn = (F.col(x) for x in ("TP", "FP", "FN", "TN"))
    j = stats.youden(tp, fp, fn, tn)
    return c.select("lang", six(stats.sensitivity(tp, fn)).alias("sensitivity"), six(stats.specificity(tn, fp)).alias("specificity"), six(j["j"]).alias("youden_j"), six(j["lo"]).alias("j_lo"), six(j["hi"]).alias("j_hi"))


@query(f"""WITH k AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, k, n, {WILSON('k', 'n')[0]} AS lo, {WILSON('k', 'n')[1]} AS hi, greatest(0, {WILSON('k', 'n')[0]}) AS lo_clamped, least(100, {WILSON('k', 'n')[1]}) AS hi_clamped, round((k / n - 0.5) / sqrt(0.25 / n), 6) AS z_half, round((k / n - 0.0625) / sqrt(0.0625 * 0.9375 / n), 6) AS z_sixteenth FROM k""")
def intervals_and_z(t):
    k, n = F.col("k"), F.col("n")
    got = t("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    w, c = stats.wilson(k, n), stats.wilson(k, n, clamp=True)
    return got.select("o_orderpriority", "k", "n", six(w["lo"]).alias("lo"), six(w["hi"]).alias("hi"), six(c["lo"]).alias("lo_clamped"), six(c["hi"]).alias("hi_clamped"), six(stats.z_against(k, n, 0.5)).alias("z_half"), six(stats.z_against(k, n, 0.0625)).alias("z_sixteenth"))


@query("""WITH d AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS both, count(*) FILTER (quality = 1 AND toxic = 1) AS only_a, count(*) FILTER (quality = 0 AND toxic = 0) AS only_b, count(*) FILTER (quality = 0 AND toxic = 1) AS neither FROM labels)
SELECT d.*, round(least(1, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, 1000000) r(i) WHERE i <= least(only_a, only_b))), 6) AS p_value FROM d""")
def paired_exact_test(t):
    l = t("labels")
    a, b = l.select("doc_id", F.col("quality").alias("right")), l.select("doc_id", (1 - F.col("toxic")).alias("right"))
    return rounded(scoring.paired(a, b, "doc_id"), "p_value")


# --- multiple choice ------------------------------------------------------------------------------------------------

CODED = """SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS duration, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS task_type, CAST(event_id % 4 AS INT) AS gold_code, CASE WHEN event_type = 'signup' THEN -1 ELSE CAST(floor(value) AS INT) % 4 END AS code FROM events"""


def coded_events(t) -> DataFrame:
    return t("events").select("event_id", F.when(F.col("user_id") % 3 == 0, "short").when(F.col("user_id") % 3 == 1, "medium").otherwise("long").alias("duration"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("task_type"), (F.col("event_id") % 4).cast("int").alias("gold_code"), F.when(F.col("event_type") == "signup", -1).otherwise(F.floor("value").cast("int") % 4).alias("code"))


MCQ = "count(*) AS n, count(*) FILTER (code >= 0 AND code = gold_code) AS correct, count(*) FILTER (code < 0) AS invalid, " + ", ".join(f"count(*) FILTER (gold_code = {i}) AS gold_{x}, count(*) FILTER (code = {i}) AS chosen_{x}" for i, x in enumerate("ABCD"))


@query(f"WITH c AS ({CODED}), s AS (SELECT duration, {MCQ} FROM c GROUP BY duration) SELECT *, round(100.0 * correct / n, 6) AS Acc_pct, round(100.0 * greatest(gold_A, gold_B, gold_C, gold_D) / n, 6) AS majority_pct, CASE greatest(gold_A, gold_B, gold_C, gold_D) WHEN gold_A THEN 'A' WHEN gold_B THEN 'B' WHEN gold_C THEN 'C' ELSE 'D' END AS majority_letter, greatest(0, {WILSON('correct', 'n')[0]}) AS Acc_lo, least(100, {WILSON('correct', 'n')[1]}) AS Acc_hi FROM s")
def mcq_scores_by_duration(t):
    return rounded(scoring.mcq_scores(coded_events(t), ["duration"]), "Acc_pct", "majority_pct", "Acc_lo", "Acc_hi")


@query(f"""WITH c AS ({CODED}), u AS (SELECT 'all' AS "grouping", NULL AS value, code, gold_code FROM c UNION ALL SELECT 'duration', duration, code, gold_code FROM c UNION ALL SELECT 'task_type', task_type, code, gold_code FROM c WHERE task_type <> '') SELECT "grouping", value, count(*) AS n, count(*) FILTER (code >= 0 AND code = gold_code) AS correct, round(100.0 * count(*) FILTER (code >= 0 AND code = gold_code) / count(*), 6) AS Acc_pct FROM u GROUP BY 1, 2""")
def mcq_accuracy_groupings(t):
    return rounded(scoring.mcq_by_group(coded_events(t), ["duration", "task_type"]), "Acc_pct")


@query(f"""WITH c AS ({CODED}), s AS (SELECT task_type, count(*) AS n, count(*) FILTER (code >= 0 AND code = gold_code) AS correct FROM c GROUP BY 1), d AS (SELECT task_type, duration, 100.0 * count(*) FILTER (code >= 0 AND code = gold_code) / count(*) AS a FROM c GROUP BY 1, 2)
SELECT s.task_type, n, correct, round(max(a) FILTER (duration = 'short'), 6) AS short_Acc, round(max(a) FILTER (duration = 'medium'), 6) AS medium_Acc, round(max(a) FILTER (duration = 'long'), 6) AS long_Acc, 25.0::DOUBLE AS chance FROM s JOIN d USING (task_type) GROUP BY ALL""")
def mcq_sweep(t):
    c = coded_events(t)
    d = scoring.mcq_scores(c, ["task_type", "duration"]).select("task_type", "duration", "Acc_pct")
    return rounded(reports.mcq_sweep(scoring.mcq_scores(c, ["task_type"]).select("task_type", "n", "correct"), d, ["task_type"]), "short_Acc", "medium_Acc", "long_Acc")


# --- extraction: the functions as they are against SQL that consumes where they look around --------------------------

_W = r"[^\p{L}\p{N}\p{M}_]"  # no part of a word
_HEAD = r"(?:final answer|final|answer|prediction)"


def _first(x: str, *patterns: str) -> str:
    """SQL: group 1 of the first pattern that matches x, else null."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, $p${p}$p$, 1), '')" for p in patterns) + ")"


def _sql_yes_no(x: str) -> str:
    found = _first(x, rf"(?i){_HEAD}\s*[:：]\s*(yes|no)(?:{_W}|$)", rf"(?i)(?:^|{_W})(yes|no)(?:[\s.,!?)]|$)")
    return f"CASE lower({found}) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 ELSE -1 END"


def _sql_two_way(x: str) -> str:
    alone = r"(?i)(?:^|[^A-Za-z0-9/])([AB])(?:[^A-Za-z0-9/]|$)"
    split = rf"(?is)^(|.*?{_W})({_HEAD[3:-1]})(?:{_W}.*)?$"
    part = lambda g: f"regexp_extract({x}, $p${split}$p$, {g})"
    plain = _first(
        x, rf"(?i){_HEAD}\s*[:：]\s*([AB])(?:{_W}|$)", rf"(?i)(?:option|choice)\s*[:：]?\s*([AB])(?:{_W}|$)", r"(?i)[(\[{]\s*([AB])\s*[)\]}]",
        rf"(?i)(?:^|{_W})([AB])\s*[.)][\p{{L}}\p{{N}}\p{{M}}_]",
    )
    after = f"CASE WHEN {part(2)} <> '' THEN substr({x}, length({part(1)}) + length({part(2)}) + 1) END"
    found = f"coalesce({plain}, {_first(part(1), alone)}, {_first(after, alone)}, {_first(x, alone)})"
    return f"CASE upper({found}) WHEN 'A' THEN 1 WHEN 'B' THEN 0 ELSE -1 END"


def _sql_four_way(x: str) -> str:
    found = _first(
        x, rf"(?i){_HEAD}\s*[:：]\s*\(?\s*([ABCD])(?:{_W}|$)", rf"(?i)(?:option|choice)\s*[:：]?\s*\(?\s*([ABCD])(?:{_W}|$)", r"(?i)[(\[{]\s*([ABCD])\s*[)\]}]",
        r"(?:^|[^A-Za-z0-9])([ABCD])\s*[.)]", r"(?:^|[^A-Za-z0-9/])([ABCD])(?:[^A-Za-z0-9/]|$)",
    )
    return f"coalesce(instr('ABCD', upper({found})), 0) - 1"


#: The options of all four-way items here.
OPTIONS = ["A. one thing", "B. another thing", "C. a third thing.", "D. no"]


def _sql_choice(x: str) -> str:
    last = r"(?s)^(?:.*[^A-Za-z0-9])?(?:([B-D])(?:[^A-Za-z0-9].*)?|A(?:[^A-Za-z0-9\s].*|\s(?:[^a-z].*)?)?)$"
    last_a = last.replace("([B-D])", "[B-D]").replace("|A(?:", "|(A)(?:")
    found = _first(
        x, rf"(?i)(?:^|{_W})(?:the\s+)?best\s+answer\s+is\s*[:.]?\s*[(\[]?([A-D])[)\]]?",
        r"(?i)(?:final\s+answer|final|answer|prediction|option|choice)\s*[:：]\s*[(\[]?([A-D])[)\]]?",
        r"^[(\[]?([A-D])[)\]]?\s*[.):]", r"^\s*([A-D])\s*$", r"[(\[{]\s*([A-D])\s*[)\]}]", last, last_a,
    )
    bodies = "['one thing', 'another thing', 'a third thing']"  # a body of under four letters is no quote
    quoted = f"list_filter({bodies}, lambda o: contains(lower({x}), o))"
    return f"CASE WHEN {found} IS NOT NULL THEN instr('ABCD', upper({found})) - 1 WHEN len({quoted}) = 1 THEN list_position({bodies}, {quoted}[1]) - 1 ELSE -1 END"


_CLEAN = r"trim(regexp_replace(nfc_normalize(coalesce({0}, '')), '[\s\p{{Z}}]+', ' ', 'g'))"
_TEXTS = f"(SELECT conv_id, turn, {_CLEAN.format('text')} AS x FROM conversations)"


def _options() -> Column:
    return F.array(*map(F.lit, OPTIONS))


def _normalised(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", pythonic.nfkc("text").alias("x"))


@query(f"SELECT conv_id, turn, CAST({_sql_yes_no('x')} AS INT) AS code FROM {_TEXTS}")
def extract_yes_no(t):
    return _normalised(t).select("conv_id", "turn", extract.yes_no(F.col("x")).cast("int").alias("code"))


@query(f"SELECT conv_id, turn, CAST({_sql_two_way('x')} AS INT) AS code FROM {_TEXTS}")
def extract_two_way(t):
    return _normalised(t).select("conv_id", "turn", extract.two_way(F.col("x")).cast("int").alias("code"))


@query(f"SELECT conv_id, turn, CAST({_sql_four_way('x')} AS INT) AS code FROM {_TEXTS}")
def extract_four_way(t):
    return _normalised(t).select("conv_id", "turn", extract.four_way(F.col("x")).alias("code"))


@query(f"SELECT conv_id, turn, CAST({_sql_choice('x')} AS INT) AS code FROM {_TEXTS}")
def extract_choice(t):
    return _normalised(t).select("conv_id", "turn", extract.choice(F.col("x"), _options()).alias("code"))


#: Replies in which forms compete, stand at edges or look like answers and are none.
REPLIES = [
    "", "yes", "No.", "YES!", "yesterday no", "noon", "I know, yes", "Answer: no, not yes", "final answer : Yes", "prediction：no", "answer: nothing, yes?", "yes-no no",
    "A", "b", "(A)", "[ b ]", "{C}", "A.", "B) since", "A/B", "a/b or B", "option B", "Choice: a", "choice d.", "Answer: (C)", "The best answer is: D", "best answer is (b)", "I think A or B; final answer C",
    "A man walks by", "A man, B", "It shows A. Then B. Then C", "Answer is B", "B is the answer, not A", "final answer? maybe A", "no answer", "D)", "(D) because B", "x=A1 B2", "AB CD", "A B C D", "C: red", " D ",
    "It is one thing", "another thing or one thing", "a third thing", "no", "élan A été B", "Ano", "noé", "é yes", "answer: Aé B", "the final answer: option C", "A)x", "1.A) b", "pick [c] or [d]", "Answer:b",
]
_REPLIES = "(VALUES " + ", ".join(f"({i}, $x${x}$x$)" for i, x in enumerate(REPLIES)) + ") AS r(k, raw)"


@query(
    f"SELECT conv_id, turn, CAST({_sql_yes_no('x')} AS INT) AS yes_no, CAST({_sql_two_way('x')} AS INT) AS two_way, CAST({_sql_four_way('x')} AS INT) AS four_way, CAST({_sql_choice('x')} AS INT) AS choice"
    f" FROM (SELECT c.conv_id, c.turn, {_CLEAN.format('raw')} AS x FROM conversations c JOIN {_REPLIES} ON r.k = (c.conv_id * 7 + c.turn) % {len(REPLIES)})"
)
def extract_adversarial(t):
    """Every turn gets one of the replies that are hard to read."""
    x = F.col("x")
    replies = F.array(*map(F.lit, REPLIES))
    raw = F.get(replies, F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(REPLIES))).cast("int"))
    rows = t("conversations").select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", pythonic.nfkc("raw").alias("x"))
    found = {"yes_no": extract.yes_no(x), "two_way": extract.two_way(x), "four_way": extract.four_way(x), "choice": extract.choice(x, _options())}
    return rows.select("conv_id", "turn", *(c.cast("int").alias(k) for k, c in found.items()))


def replies(t) -> DataFrame:
    c = t("conversations").select(F.col("conv_id").alias("index"), "turn", F.coalesce("text", F.lit("")).alias("model_output"))
    return c.withColumn("type", F.element_at(F.array(*map(F.lit, ("yes_no", "multiple_choice", "multiple_choice_4", "mcq4"))), (F.col("turn") % 4 + 1).cast("int")))


def _sql_answer(x: str, kind: str) -> str:
    kinds = (("yes_no", _sql_yes_no), ("multiple_choice", _sql_two_way), ("multiple_choice_4", _sql_four_way), ("mcq4", _sql_choice))
    return f"CASE WHEN {x} = '' THEN -1 " + " ".join(f"WHEN {kind} = '{k}' THEN {f(x)}" for k, f in kinds) + " END"


_TYPES = "(['yes_no', 'multiple_choice', 'multiple_choice_4', 'mcq4'])[CAST(turn % 4 AS INT) + 1]"
_BY_TYPE = f"SELECT conv_id AS index, turn, type, CAST({_sql_answer('x', 'type')} AS INT) AS code FROM (SELECT *, {_TYPES} AS type FROM {_TEXTS})"
_LABEL = "CASE WHEN code < 0 THEN '' WHEN type = 'yes_no' THEN (['no', 'yes'])[code + 1] WHEN type = 'multiple_choice' THEN (['b', 'a'])[code + 1] ELSE substr('abcd', code + 1, 1) END"


@query(f"SELECT *, {_LABEL} AS label FROM ({_BY_TYPE})")
def extract_by_type(t):
    code = extract.answer(F.col("norm"), F.col("type"), _options())
    r = replies(t).withColumn("norm", pythonic.nfkc("model_output"))
    return r.select("index", "turn", "type", code.cast("int").alias("code")).withColumn("label", extract.label(F.col("code"), F.col("type")))


@query(f"SELECT conv_id, turn, x AS text FROM {_TEXTS}")
def normalised_text(t):
    return _normalised(t).withColumnRenamed("x", "text")


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM conversations")
def collapsed_text(t):
    return t("conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("text"))


@query("SELECT p_partkey, CAST(CASE WHEN regexp_matches(upper(p_name), '[A-D]') THEN instr('ABCD', regexp_extract(upper(p_name), '[A-D]', 0)) - 1 ELSE -1 END AS INT) AS gold FROM part")
def gold_letters(t):
    return t("part").select("p_partkey", extract.gold_letter(F.col("p_name")).alias("gold"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' WHEN quality = 0 THEN 'no' ELSE '' END AS binary_label, CASE WHEN quality = 1 THEN 'a' WHEN quality = 0 THEN 'b' ELSE '' END AS two_way_label, substr('abcd', CAST(doc_id % 5 AS INT) + 1, 1) AS four_way_label, quality = toxic AS strict FROM labels")
def answer_labels(t):
    four = F.when(F.col("doc_id") % 5 == 4, -1).otherwise(F.col("doc_id") % 5).cast("int")
    return t("labels").select("doc_id", extract.label(F.col("quality"), F.lit("yes_no")).alias("binary_label"), extract.label(F.col("quality"), F.lit("multiple_choice")).alias("two_way_label"), extract.label(four, F.lit("mcq4")).alias("four_way_label"), extract.item_correct(F.col("quality"), F.col("toxic")).alias("strict"))


# --- names, prompts, messages ---------------------------------------------------------------------------------------

FILE = "'subj_set_' || (['uniform', 'random', 'hornet', 'f2cfull', 'f2c', 'other'])[CAST(o_orderkey % 6 AS INT) + 1] || CAST(o_orderkey % 33 AS VARCHAR) || (['', '_full', '_pool64', '_noencoder_pool8'])[CAST(o_orderkey % 4 AS INT) + 1] || (['', '_shuf0', '_rev', '_novid', '_shuf12'])[CAST(o_orderkey % 5 AS INT) + 1]"


def file_names(t) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    name = F.concat(F.lit("subj_set_"), pick(["uniform", "random", "hornet", "f2cfull", "f2c", "other"], 6), (k % 33).cast("string"), pick(["", "_full", "_pool64", "_noencoder_pool8"], 4), pick(["", "_shuf0", "_rev", "_novid", "_shuf12"], 5), F.lit(".json"))
    return t("orders").select("o_orderkey", name.alias("file"))


@query(f"""WITH f AS (SELECT o_orderkey, {FILE} AS s FROM orders), a AS (SELECT *, CASE WHEN regexp_matches(s, '_shuf[0-9]+$') THEN 'shuffled_frames' WHEN s LIKE '%\\_rev' ESCAPE '\\' THEN 'reversed_frames' WHEN s LIKE '%\\_novid' ESCAPE '\\' THEN 'no_video' ELSE 'none' END AS ablation, regexp_replace(s, '(_shuf[0-9]+|_rev|_novid)$', '') AS r FROM f),
m AS (SELECT *, regexp_extract(r, '_(uniform|random|hornet|burst|f2cfull|f2c)([0-9]+)((_full|_noencoder)?(_pool[0-9]+)?)$', 1) AS sampler, regexp_extract(r, '_(uniform|random|hornet|burst|f2cfull|f2c)([0-9]+)((_full|_noencoder)?(_pool[0-9]+)?)$', 2) AS n, regexp_extract(r, '_(uniform|random|hornet|burst|f2cfull|f2c)([0-9]+)((_full|_noencoder)?(_pool[0-9]+)?)$', 3) AS v FROM a)
SELECT o_orderkey, CASE WHEN sampler = '' THEN 'none' ELSE sampler END AS sampler, CAST(CASE WHEN sampler = '' THEN 0 ELSE CAST(n AS INT) END AS INT) AS num_frames, ablation, ltrim(v, '_') AS variant, CASE WHEN sampler = '' OR n = '0' THEN ablation ELSE sampler || n || CASE WHEN ablation = 'none' THEN '' ELSE '_' || ablation END END AS tag FROM m WHERE sampler <> '' OR ablation = 'no_video'""")
def cells_from_file_names(t):
    got = file_names(t).where(text.readable_prediction(F.col("file"))).withColumn("c", text.cell_of(F.col("file"))).where("c is not null").select("o_orderkey", "c.*")
    return got.withColumn("tag", text.cell_tag(F.col("sampler"), F.col("num_frames"), F.col("ablation")))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def url_stems(t):
    return t("pages").select("page_id", text.stem(F.col("url")).alias("stem"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 BETWEEN 1 AND 7 THEN 'speed' WHEN o_orderkey % 20 BETWEEN 8 AND 13 THEN 'magnitude' WHEN o_orderkey % 20 = 14 THEN 'direction (translational)' WHEN o_orderkey % 20 = 15 THEN 'direction (rotational)' END AS category FROM orders")
def clip_categories(t):
    clip = F.concat(F.lit("videos/"), F.lpad((F.col("o_orderkey") % 20).cast("string"), 2, "0"), F.lit("_05_1.mp4"))
    o = t("orders").select("o_orderkey", text.category_id(clip).alias("category_id"))
    c = o.sparkSession.createDataFrame(CATEGORIES, "category_id int, category string")
    return o.join(F.broadcast(c), "category_id", "left").select("o_orderkey", "category")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || ' Please output Yes or No.' WHEN 1 THEN text || ' Please output A or B.' WHEN 2 THEN text || ' Please output A, B, C, or D.' ELSE '" + text.CHOICE_PREFIX + "' || chr(10) || chr(10) || text || chr(10) || 'A. one' || chr(10) || 'B) two' || chr(10) || 'C. C three' || chr(10) || 'D. four' || chr(10) || chr(10) || 'The best answer is:' END AS prompt FROM conversations")
def question_prompts(t):
    options = F.array(F.lit("one"), F.lit("B) two"), F.lit("C three"), F.lit("four"))
    return replies(t).select(F.col("index").alias("conv_id"), "turn", text.prompt(F.col("model_output"), F.col("type"), options).alias("prompt"))


@query(r"""WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'key sk-abcDEF_1234-x failed' WHEN 1 THEN 'auth Bearer a.b-c9 no' WHEN 2 THEN 'RESOURCE_EXHAUSTED: quota, ''retryDelay'': ''' || CAST(event_id % 50 AS VARCHAR) || 's''' WHEN 3 THEN 'Error code: 404 <a & "b">' WHEN 4 THEN '' ELSE 'timeout it''s' END AS message FROM events)
SELECT event_id, regexp_replace(message, '(sk-[A-Za-z0-9_\-]{8,}|hf_[A-Za-z0-9]{8,}|Bearer\s+\S+)', '<REDACTED>', 'g') AS redacted, CASE WHEN event_id % 6 = 2 THEN CAST(event_id % 50 AS DOUBLE) END AS delay, CASE event_id % 6 WHEN 2 THEN 'quota' WHEN 3 THEN 'fatal' WHEN 4 THEN 'none' ELSE 'other' END AS error_class, replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM m""")
def error_messages(t):
    k = F.col("event_id")
    m = F.when(k % 6 == 0, "key sk-abcDEF_1234-x failed").when(k % 6 == 1, "auth Bearer a.b-c9 no").when(k % 6 == 2, F.concat(F.lit("RESOURCE_EXHAUSTED: quota, 'retryDelay': '"), (k % 50).cast("string"), F.lit("s'"))).when(k % 6 == 3, 'Error code: 404 <a & "b">').when(k % 6 == 4, "").otherwise("timeout it's")
    e = t("events").select("event_id", m.alias("message"))
    c = F.col("message")
    return e.select("event_id", text.redact(c).alias("redacted"), text.retry_delay(c).alias("delay"), text.error_class(c).alias("error_class"), text.escape_html(c).alias("escaped"))


# --- filters and guards ---------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1 ORDER BY f LIMIT 20) SELECT event_id, e.user_id, event_type FROM events e JOIN k USING (user_id) WHERE event_type IN ('view', 'click')")
def first_distinct_users(t):
    return ranking.first_distinct(t("events"), "user_id", "event_id", 20).where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 10)")
def whole_cells_only(t):
    return reports.cell_guard(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 10)


@query("SELECT source, bool_and(lang = 'en') AND count(*) > 0 AS all_english, bool_or(lang = 'fr') AS any_french FROM documents GROUP BY source")
def all_of_one_kind(t):
    return t("documents").groupBy("source").agg((F.bool_and(F.col("lang") == "en") & (F.count("*") > 0)).alias("all_english"), F.bool_or(F.col("lang") == "fr").alias("any_french"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def prefix_of_rows(t):
    return t("events").orderBy("event_id").limit(100).select("event_id", "user_id")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE event_type <> 'error') SELECT event_id, CAST(n AS BIGINT) AS index FROM r")
def dense_index(t):
    return ranking.dense_index(t("events").where("event_type <> 'error'").select("event_id"), "event_id")


@query("WITH g AS (SELECT min(event_id) AS gap FROM events WHERE event_id % 500 = 499) SELECT event_id, user_id FROM events, g WHERE gap IS NULL OR event_id < gap")
def finished_prefix(t):
    e = t("events").select("event_id", "user_id", (F.col("event_id") % 500 != 499).alias("done"))
    return ranking.finished_prefix(e, "event_id", "done").select("event_id", "user_id")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS key, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) SELECT o_orderkey, coalesce(a.c_acctbal, b.c_acctbal) AS found FROM orders o JOIN customer c ON c_custkey = o_custkey LEFT JOIN s a ON a.key = CAST(o_custkey AS VARCHAR) LEFT JOIN s b ON b.key = c.c_name")
def selection_by_two_keys(t):
    c = t("customer")
    s = c.where("c_custkey % 3 <> 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name")).alias("key"), F.array("c_acctbal").alias("indices"), F.lit(None).cast("array<double>").alias("scales"))
    rows = t("orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("video_path")), "o_custkey").withColumn("index", F.col("o_custkey"))
    return joins.with_selection(rows, s).select("o_orderkey", F.try_element_at("indices", F.lit(1)).alias("found"))


@query("WITH e AS (SELECT url, page_id, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages WHERE page_id % 2 = 0), x AS (SELECT url, min(page_id) AS page_id FROM e GROUP BY 1), n AS (SELECT b, min(page_id) AS page_id FROM e GROUP BY 1) SELECT p.page_id AS id, coalesce(x.page_id, n.page_id) AS entry FROM pages p LEFT JOIN x ON x.url = p.url LEFT JOIN n ON n.b = regexp_extract(p.url, '([^/]*)$', 1)")
def entry_by_path_or_name(t):
    p = t("pages").select(F.col("page_id").alias("id"), "url")
    e = t("pages").where("page_id % 2 = 0").groupBy(F.col("url").alias("key")).agg(F.min("page_id").alias("entry"))
    return joins.by_path_or_name(p, e, "url", "key", "entry", "entry").select("id", "entry")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id")
def presence_flags(t):
    return joins.flagged(t("documents").select("doc_id"), t("labels").where("toxic = 0"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def resume_to_do(t):
    previous = t("labels").select("doc_id", F.when(F.col("quality") == 1, "x").otherwise(" ").alias("model_output"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return joins.to_do(t("documents").select("doc_id", "source"), previous, ["doc_id"])


@query("SELECT doc_id AS index, 'new' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'old' FROM labels WHERE doc_id % 3 <> 0")
def merged_runs(t):
    fresh = t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("index"), F.lit("new").alias("origin"))
    old = t("labels").select(F.col("doc_id").alias("index"), F.lit("old").alias("origin"))
    return joins.merged_results(old, fresh)


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def aligned_suites(t):
    a = t("customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders"))
    b = t("supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return joins.aligned(a, b, ["k"])


@query("SELECT n_name AS model, coalesce(b.v, c.v) AS best, CASE WHEN b.v IS NOT NULL THEN 'measured' WHEN c.v IS NOT NULL THEN 'cited' END AS best_source FROM nation LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) c ON c_nationkey = n_nationkey")
def measured_or_cited(t):
    n = t("nation").select(F.col("n_nationkey"), F.col("n_name").alias("model"))
    m = t("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("best"))
    c = t("customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_acctbal").alias("best"))
    return joins.filled(n.join(m, "n_nationkey", "left"), c, "n_nationkey", ["best"]).select("model", "best", "best_source")


@query("WITH w AS (SELECT o_custkey, list(DISTINCT CAST(o_orderkey % 30 AS INT)) AS l FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_sort(list_filter(l, lambda x: x NOT IN (0, 1, 2, 3, 5, 8, 13, 21)))[1:5], ' ') AS missing FROM w")
def missing_frames(t):
    w = t("orders").groupBy("o_custkey").agg(F.collect_set((F.col("o_orderkey") % 30).cast("int")).alias("l"))
    have = F.array(*(F.lit(x) for x in (0, 1, 2, 3, 5, 8, 13, 21)))
    return w.select("o_custkey", F.array_join(joins.missing_of(F.col("l"), have).cast("array<string>"), " ").alias("missing"))


@query("SELECT r.l_returnflag, s.l_linestatus, y.y AS year FROM (SELECT DISTINCT l_returnflag FROM lineitem) r, (SELECT DISTINCT l_linestatus FROM lineitem) s, (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS y FROM lineitem) y WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_quantity > 49 AND l.l_linenumber = 7 AND l.l_discount > 0.09 AND l.l_returnflag = r.l_returnflag AND l.l_linestatus = s.l_linestatus AND year(l.l_shipdate) = y.y)")
def missing_cells(t):
    l = t("lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_quantity", "l_linenumber", "l_discount")
    axes = ["l_returnflag", "l_linestatus", "year"]
    return joins.missing_cells(l, axes, l.where("l_quantity > 49 and l_linenumber = 7 and l_discount > 0.09").drop("l_quantity", "l_linenumber", "l_discount"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def first_of_each(t):
    return joins.first_of_each(t("events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_of_each(t):
    return scoring.last_by(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


# --- sampling -------------------------------------------------------------------------------------------------------

TOTALS = "SELECT user_id, CAST(count(*) AS INT) AS total FROM events GROUP BY 1"


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def spaced(total: str, n: str, whole: str, digits: str = "") -> str:
    return f"list_transform(range(0, {n}), lambda i: CAST(CASE WHEN i = {n} - 1 AND {n} > 1 THEN {total} - 1 ELSE {whole}(i * (({total} - 1) / CAST(greatest({n} - 1, 1) AS DOUBLE)){digits}) END AS INT))"


@query(f"WITH u AS ({TOTALS}) SELECT user_id, total, " + ", ".join(f"array_to_string(CASE WHEN total <= {n} THEN range(0, total) ELSE {spaced('total', str(n), 'round_even', ', 0')} END, ' ') AS u{n}" for n in (1, 4, 8, 16)) + " FROM u")
def uniform_samples(t):
    e = t("events").groupBy("user_id").agg(F.count("*").cast("int").alias("total"))
    return e.select("user_id", "total", *(joined(sampling.uniform(F.col("total"), F.lit(n))).alias(f"u{n}") for n in (1, 4, 8, 16)))


@query(f"WITH u AS ({TOTALS}) SELECT user_id, array_to_string(CASE WHEN total >= 32 THEN {spaced('total', '32', 'floor')} ELSE list_concat(range(0, total), list_transform(range(0, 32 - total), lambda x: total - 1)) END, ' ') AS pool, array_to_string(range(0, total, 3)[1:8], ' ') AS steps, array_to_string(list_reverse(range(0, total)), ' ') AS reversed FROM u")
def pooled_samples(t):
    e = t("events").groupBy("user_id").agg(F.count("*").cast("int").alias("total"))
    n = F.col("total")
    return e.select("user_id", joined(sampling.pool(n, F.lit(32))).alias("pool"), joined(sampling.fixed_step(n, F.lit(30.0), F.lit(10.0), F.lit(8))).alias("steps"), joined(F.reverse(F.sequence(F.lit(0), n - 1))).alias("reversed"))


@query("WITH f AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id, array_to_string(list_sort(list(event_id) FILTER (r <= 5)), ' ') AS kept FROM f GROUP BY 1")
def top_k_frames(t):
    e = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("f"))
    return e.select("user_id", joined(sampling.top_k(F.col("f.event_id"), F.col("f.value"), F.lit(5))).alias("kept"))


@query("WITH f AS (SELECT user_id, list(event_id ORDER BY event_id) AS p FROM events GROUP BY 1) SELECT user_id, array_to_string(list_transform(list_sort(list_distinct([0, len(p) // 2, len(p) - 1]))[1:2], lambda i: p[i + 1]), ' ') AS replayed FROM f")
def replayed_selection(t):
    e = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("p"))
    n = F.size("p")
    sel = F.array_distinct(F.array(n - 1, F.lit(0), F.floor(n / 2).cast("int")))
    return e.select("user_id", joined(sampling.replayed(sel, F.col("p"), F.lit(2))).alias("replayed"))


@query("WITH s AS (SELECT user_id, CAST(count(*) AS INT) AS total, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT user_id, CASE WHEN sd IS NULL OR sd < 25 THEN 'uniform' ELSE 'learned' END AS rule FROM s")
def learned_or_uniform(t):
    s = t("events").groupBy("user_id").agg(F.count("*").cast("int").alias("total"), F.stddev_samp("value").alias("sd"))
    kept = F.array(F.lit(-1))
    return s.select("user_id", F.when(F.array_contains(sampling.or_uniform(kept, F.col("sd"), F.col("total"), F.lit(4), 25.0), -1), "learned").otherwise("uniform").alias("rule"))


@query()
def random_samples(t):
    e = t("events").groupBy("user_id").agg(F.count("*").cast("int").alias("total")).withColumn("video_path", F.concat(F.lit("videos/"), F.col("user_id").cast("string"), F.lit(".mp4")))
    drawn = pythonic.random_named("video_path", "total", F.lit(8), F.lit(0))
    return e.select("user_id", joined(drawn).alias("named"), joined(pythonic.random_numpy("total", F.lit(8), F.lit(0))).alias("numbered"), joined(pythonic.shuffled_named(drawn, "video_path", F.lit(0))).alias("shuffled"))


@query("WITH f AS (SELECT c_custkey, CAST(c_custkey % 90 AS INT) AS total, CAST(c_custkey % 7 AS DOUBLE) AS rate FROM customer), g AS (SELECT *, CASE WHEN rate > 0.001 THEN rate ELSE 30.0 END AS fps FROM f), h AS (SELECT *, CASE WHEN total > 0 THEN list_sort(list_distinct(list_transform(range(0, greatest(1, CAST(floor(total / fps) AS INT) + 1)), lambda x: least(CAST(round_even(x * fps, 0) AS INT), total - 1)))) ELSE [] END AS l FROM g) SELECT c_custkey, array_to_string(l, ' ') AS frames FROM h")
def one_frame_a_second(t):
    c = t("customer").select("c_custkey", (F.col("c_custkey") % 90).cast("int").alias("total"), sampling.frame_rate((F.col("c_custkey") % 7).cast("double")).alias("fps"))
    return c.select("c_custkey", joined(sampling.one_per_second(F.col("total"), F.col("fps"))).alias("frames"))


# --- segmentation ---------------------------------------------------------------------------------------------------

SERIES = "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS score FROM events"


def event_series(t) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("value").alias("score"))


NEIGHBOURS = f"s AS ({SERIES}), n AS (SELECT *, lag(score) OVER (PARTITION BY key ORDER BY pos) AS b, lead(score) OVER (PARTITION BY key ORDER BY pos) AS a FROM s), v AS (SELECT key, pos, score FROM n WHERE a IS NULL OR b IS NULL OR (score <= a AND score <= b))"


@query(f"WITH {NEIGHBOURS} SELECT * FROM v")
def valleys(t):
    return segments.valleys(event_series(t))


@query(f"WITH {NEIGHBOURS}, r AS (SELECT key, pos AS lo, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS hi FROM v), p AS (SELECT r.key, r.lo, arg_max(s.pos, struct_pack(sc := s.score, p := -s.pos)) AS pos FROM r JOIN s ON s.key = r.key AND s.pos BETWEEN r.lo AND r.hi WHERE hi IS NOT NULL GROUP BY 1, 2) SELECT DISTINCT key, pos FROM p UNION SELECT key, min(pos) FROM s GROUP BY key HAVING count(*) = 1")
def basin_peaks(t):
    return segments.basin_peaks(event_series(t))


CLIPS = "SELECT l_orderkey % 200 AS key, l_returnflag AS s_key, CAST(l_partkey % 400 AS INT) AS lo, CAST(l_partkey % 400 + l_linenumber AS INT) AS hi, l_quantity AS s FROM lineitem"


def line_clips(t) -> DataFrame:
    lo = (F.col("l_partkey") % 400).cast("int")
    return t("lineitem").select((F.col("l_orderkey") % 200).alias("key"), F.col("l_returnflag").alias("s_key"), lo.alias("lo"), (lo + F.col("l_linenumber")).cast("int").alias("hi"), F.col("l_quantity").alias("s"))


@query(f"WITH c AS ({CLIPS}), r AS (SELECT *, max(hi) OVER (PARTITION BY key, s_key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key, s_key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT key, s_key, min(lo) AS lo, max(hi) AS hi, count(*) AS n_merged, min(s) AS s FROM i GROUP BY key, s_key, island")
def merged_intervals(t):
    return segments.merged(line_clips(t), ["key", "s_key"], value="s")


@query(f"WITH c AS ({CLIPS}), f AS (SELECT key, unnest(range(lo, hi + 1)) AS frame, s FROM c) SELECT key, CAST(frame AS INT) AS frame, min(s) AS s FROM f GROUP BY 1, 2")
def frame_plan(t):
    return segments.frame_plan(line_clips(t).withColumn("idxs", F.sequence("lo", "hi")))


@query("WITH p AS (SELECT p_partkey, CAST(p_partkey % 40 AS INT) AS c, CAST(1 + p_partkey % 11 AS INT) AS l, 40 AS n FROM part), h AS (SELECT *, greatest(0, c - (l - 1) // 2) AS lo, least(n - 1, c + (l - 1 - (l - 1) // 2)) AS hi FROM p), m AS (SELECT *, greatest(0, least(lo, hi - l + 1)) AS lo2 FROM h) SELECT p_partkey, CAST(lo2 AS INT) AS lo, CAST(least(n - 1, greatest(hi, lo2 + l - 1)) AS INT) AS hi, CAST(greatest(1, round_even(8 / pow(greatest(l / 4.0, 1.0), 2), 0)) AS INT) AS crops FROM m")
def clip_windows(t):
    p = t("part").select("p_partkey", (F.col("p_partkey") % 40).cast("int").alias("pos"), (1 + F.col("p_partkey") % 11).cast("int").alias("length"), F.lit(40).alias("n"))
    return segments.clip_windows(p).select("p_partkey", "lo", "hi", sampling.crops(F.col("length") / 4).alias("crops"))


SHOTS = """e AS (SELECT vec_id // 50 AS key, vec_id % 50 AS pos, embedding[1]::DOUBLE AS score, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT key, pos, score, list_transform(e, lambda x: CAST(x / sqrt(list_dot_product(e, e)) AS FLOAT)::DOUBLE) AS f FROM e)"""
SHOT_PEAKS = f"""{SHOTS}, z AS (SELECT key, count(*) AS n FROM u GROUP BY 1), nb AS (SELECT *, lag(score) OVER (PARTITION BY key ORDER BY pos) AS b, lead(score) OVER (PARTITION BY key ORDER BY pos) AS a FROM u), v AS (SELECT key, pos FROM nb WHERE a IS NULL OR b IS NULL OR (score <= a AND score <= b)),
r AS (SELECT key, pos AS lo, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS hi FROM v), p AS (SELECT DISTINCT key, pos FROM (SELECT r.key, r.lo, arg_max(u.pos, struct_pack(sc := u.score, p := -u.pos)) AS pos FROM r JOIN u ON u.key = r.key AND u.pos BETWEEN r.lo AND r.hi WHERE hi IS NOT NULL GROUP BY 1, 2) UNION SELECT key, 0 FROM z WHERE n = 1)"""
#: From anchors a (key, c, n, most) to their lengths l: all pairs of each window, where the engine takes sums of vectors.
LENGTHS = """d AS (SELECT x.key, x.pos AS i, y.pos AS j, list_dot_product(x.f, y.f) AS dot FROM u x JOIN u y ON x.key = y.key AND x.pos < y.pos),
w0 AS (SELECT *, unnest(range(1, most + 1)) AS size FROM a), w1 AS (SELECT *, greatest(0, c - (size - 1) // 2) AS lo, least(n - 1, c + size - 1 - (size - 1) // 2) AS hi FROM w0), w2 AS (SELECT * REPLACE (greatest(0, least(lo, hi - size + 1)) AS lo) FROM w1), w AS (SELECT * REPLACE (least(n - 1, greatest(hi, lo + size - 1)) AS hi) FROM w2),
sc AS (SELECT w.key, c, size, most, avg(score) AS mean FROM w JOIN u ON u.key = w.key AND u.pos BETWEEN lo AND hi GROUP BY ALL), al AS (SELECT w.key, c, size, 2 * sum(dot) / any_value((hi - lo + 1) * (hi - lo)) AS alike FROM w JOIN d ON d.key = w.key AND d.i >= lo AND d.j <= hi GROUP BY ALL),
l AS (SELECT key, c, arg_max(size, struct_pack(v := mean - 0.5 * coalesce(alike, 0) + 0.05 * size / most, s := -size)) AS length FROM sc LEFT JOIN al USING (key, c, size) GROUP BY 1, 2)"""
WINDOW = "greatest(0, least(greatest(0, c - (length - 1) // 2), least(n - 1, c + length - 1 - (length - 1) // 2) - length + 1))"


def shot_series(t) -> DataFrame:
    v, n = t("embeddings"), 50
    return v.select((F.col("vec_id") / n).cast("int").cast("string").alias("key"), (F.col("vec_id") % n).cast("int").alias("pos"), F.element_at("embedding", 1).cast("double").alias("score"), (F.col("vec_id") % n * 30).cast("int").alias("video_index"), vectors.unit(F.col("embedding")).cast("array<float>").alias("embedding"))


@query()
def segmented_series(t):
    return segments.segment(shot_series(t), 8)


@query(f"WITH {SHOTS}, z AS (SELECT key, count(*) AS n FROM u GROUP BY 1), a AS (SELECT key, pos AS c, n, 1 + pos % 9 AS most FROM u JOIN z USING (key)), {LENGTHS} SELECT CAST(key AS VARCHAR) AS key, CAST(c AS INT) AS pos, CAST(length AS INT) AS length FROM l")
def clip_lengths(t):
    series = shot_series(t)
    n = series.groupBy("key").agg(F.count("*").alias("n"))
    anchors = series.select("key", "pos", (1 + F.col("pos") % 9).cast("int").alias("most")).join(n, "key")
    return segments.clip_lengths(anchors, series).select("key", "pos", "length")


@query(f"""WITH {SHOT_PEAKS}, k AS (SELECT key, count(*) AS count FROM p GROUP BY 1), a AS (SELECT p.key, p.pos AS c, n, count, greatest(1, CAST(round_even(4.0 * 40 / count, 0) AS INT)) AS most FROM p JOIN z USING (key) JOIN k USING (key)), {LENGTHS},
g AS (SELECT key, {WINDOW} AS lo, least(n - 1, greatest(least(n - 1, c + length - 1 - (length - 1) // 2), {WINDOW} + length - 1)) AS hi, least(2, greatest(1, sqrt(count * length / 40.0::DOUBLE))) AS s FROM l JOIN a USING (key, c)),
gr AS (SELECT *, round(s, 3) AS s_key, max(hi) OVER (PARTITION BY key, round(s, 3) ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g), gi AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key, s_key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM gr), m AS (SELECT key, min(lo) AS lo, max(hi) AS hi, min(s) AS s FROM gi GROUP BY key, s_key, island),
f AS (SELECT key, unnest(range(lo, hi + 1)) AS pos, s FROM m) SELECT CAST(key AS VARCHAR) AS key, CAST(30 * pos AS INT) AS frame, round(min(s), 6) AS scale FROM f GROUP BY key, pos""")
def segmented_peaks(t):
    """The whole segmentation at a budget that holds all peaks, so that nothing is drawn at random."""
    return rounded(segments.segment(shot_series(t), 40), "scale")


_FIRST = "((p.x - u1) * (p.x - u1) + (p.y - v1) * (p.y - v1) < (p.x - u2) * (p.x - u2) + (p.y - v2) * (p.y - v2))"


def _sql_mean(side: str, axis: str, old: str) -> str:
    return f"coalesce(list_avg(list_transform(list_filter(pts, lambda p: {side}{_FIRST}), lambda p: p.{axis})), {old})"


@query(f"""WITH RECURSIVE q AS (SELECT user_id, event_id, (event_id % 97) / 97.0::DOUBLE AS x, 0.41::DOUBLE * (value / 100) AS y FROM events), g AS (SELECT user_id, list(struct_pack(x := x, y := y) ORDER BY event_id) AS pts FROM q WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
r AS (SELECT user_id, pts, 0 AS i, 0.15::DOUBLE AS u1, 0.75 * 0.41::DOUBLE AS v1, 0.55::DOUBLE AS u2, 0.45 * 0.41::DOUBLE AS v2 FROM g UNION ALL SELECT user_id, pts, i + 1, {_sql_mean('', 'x', 'u1')}, {_sql_mean('', 'y', 'v1')}, {_sql_mean('NOT ', 'x', 'u2')}, {_sql_mean('NOT ', 'y', 'v2')} FROM r WHERE i < 60),
m AS (SELECT *, len(pts) AS n, len(list_filter(pts, lambda p: {_FIRST})) AS first FROM r WHERE i = 60), a AS (SELECT * FROM m WHERE least(first, n - first) / n >= 0.15 AND sqrt((u1 - u2) * (u1 - u2) + (v1 - v2) * (v1 - v2)) >= 0.18)
SELECT p.user_id, event_id, CASE WHEN u1 IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL THEN CAST(NOT {_FIRST} AS INT) END AS lobe FROM q p LEFT JOIN a ON a.user_id = p.user_id""")
def two_lobes(t):
    e = t("events").select("user_id", "event_id", ((F.col("event_id") % 97) / F.lit(97.0)).alias("x"), (F.col("value") / 100).alias("y"))
    return segments.lobes(e, "user_id").select("user_id", "event_id", "lobe")


# --- vectors and cost -----------------------------------------------------------------------------------------------


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 5) AS relevance FROM embeddings, q")
def cosine_relevance(t):
    v = t("embeddings")
    found = v.where("vec_id = 0").select("embedding").first()  # the query: one vector
    q = F.array(*(F.lit(float(x)) for x in found.embedding)) if found else F.lit(None).cast("array<double>")
    return v.select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 5).alias("relevance")) if found else v.where("false").select("vec_id", F.lit(0.0).alias("relevance"))


@query("WITH p AS (SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1) SELECT label, n, round(m, 5) AS mean_similarity FROM p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)")
def mean_pair_similarity(t):
    return vectors.mean_pair_similarity(t("embeddings"), "label", "embedding").select("label", "n", F.round("mean_similarity", 5).alias("mean_similarity"))


@query("WITH s AS (SELECT p_partkey, p_size * 37 AS w, p_size * 23 AS h FROM part), f AS (SELECT *, least(512.0::DOUBLE / w, 512.0::DOUBLE / h) AS r FROM s), b AS (SELECT *, CASE WHEN w <= 512 AND h <= 512 THEN w ELSE greatest(1, CAST(floor(w * r) AS INT)) END AS bw, CASE WHEN w <= 512 AND h <= 512 THEN h ELSE greatest(1, CAST(floor(h * r) AS INT)) END AS bh FROM f) SELECT p_partkey, CAST(bw AS INT) AS w, CAST(bh AS INT) AS h, CAST(ceil(ceil(bw / 32) * ceil(bh / 32) * 1.2::DOUBLE) AS BIGINT) AS low_tokens, CAST(ceil(ceil(w / 32) * ceil(h / 32) * 1.2::DOUBLE) AS BIGINT) AS original_tokens FROM b")
def image_tokens(t):
    p = t("part").select("p_partkey", (F.col("p_size") * 37).alias("w"), (F.col("p_size") * 23).alias("h"))
    s = cost.shrunk(F.col("w"), F.col("h"), 512, 512)
    return p.select("p_partkey", s["w"].alias("w"), s["h"].alias("h"), cost.image_tokens(F.col("w"), F.col("h"), "low").alias("low_tokens"), cost.image_tokens(F.col("w"), F.col("h"), "original").alias("original_tokens"))


_OVER = "(ceil(w / 32) * ceil(h / 32) > 2500 AND (w > 32 OR h > 32))"
#: Sizes that a box of 2048 lets through, then shrunk step by step while they hold over 2500 patches.
CAPPED = f"""WITH RECURSIVE s AS (SELECT p_partkey, p_size * 97 + p_partkey % 61 AS w, p_size * 83 + p_partkey % 17 AS h FROM part), r AS (SELECT *, least(2048.0::DOUBLE / w, 2048.0::DOUBLE / h) AS f FROM s),
b AS (SELECT p_partkey, CAST(CASE WHEN w <= 2048 AND h <= 2048 THEN w ELSE greatest(1, floor(w * f)) END AS INT) AS w, CAST(CASE WHEN w <= 2048 AND h <= 2048 THEN h ELSE greatest(1, floor(h * f)) END AS INT) AS h FROM r),
c AS (SELECT p_partkey, w, h, sqrt(2500.0::DOUBLE / (ceil(w / 32) * ceil(h / 32))) AS f, ceil(w / 32) * ceil(h / 32) > 2500 AS more FROM b
UNION ALL SELECT p_partkey, w, h, 0.98::DOUBLE, {_OVER} FROM (SELECT p_partkey, CAST(greatest(1, floor(w * f)) AS INT) AS w, CAST(greatest(1, floor(h * f)) AS INT) AS h FROM c WHERE more))
SELECT p_partkey, CAST(ceil(ceil(w / 32) * ceil(h / 32) * 1.2::DOUBLE) AS BIGINT) AS tokens FROM c WHERE NOT more"""


def _large_sizes(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select("p_partkey", (F.col("p_size") * 97 + k % 61).alias("w"), (F.col("p_size") * 83 + k % 17).alias("h"))


@query(CAPPED)
def image_tokens_capped(t):
    return _large_sizes(t).select("p_partkey", cost.image_tokens(F.col("w"), F.col("h"), "high").alias("tokens"))


@query(f"SELECT p_partkey % 100 AS request, CAST(40 + sum(tokens) AS BIGINT) AS tokens FROM ({CAPPED}) GROUP BY 1")
def capped_requests(t):
    """Requests of many large images, each capped."""
    sizes = _large_sizes(t).groupBy((F.col("p_partkey") % 100).alias("request")).agg(F.collect_list(F.array("w", "h")).alias("sizes"))
    return sizes.select("request", cost.request_tokens(F.col("sizes"), detail="high").alias("tokens"))


@query("SELECT o_custkey, CAST(40 + sum(CAST(ceil(ceil((1 + o_orderkey % 400) / 32.0) * ceil((1 + o_orderkey % 300) / 32.0) * 1.2::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens FROM orders GROUP BY 1")
def request_tokens(t):
    sizes = F.collect_list(F.array(1 + F.col("o_orderkey") % 400, 1 + F.col("o_orderkey") % 300))
    return t("orders").groupBy("o_custkey").agg(sizes.alias("sizes")).select("o_custkey", cost.request_tokens(F.col("sizes")).alias("tokens"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size > 20 THEN greatest(1, floor(p_size * (20.0::DOUBLE / p_size))) ELSE p_size END AS INT) AS side, CAST(CASE WHEN p_size / 10.0 > 1.000001 THEN greatest(1, round_even(640 / (p_size / 10.0::DOUBLE), 0)) ELSE 640 END AS INT) AS scaled, round(least(60, 1.5 * pow(2, p_size % 8)), 6) AS wait, CASE WHEN p_size / 5.0 <= 8 THEN 5 ELSE 10 END AS tick FROM part")
def size_rules(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", cost.longest_side(s, s, 20)["w"].alias("side"), cost.scaled_size(F.lit(640), F.lit(640), s / 10)["w"].alias("scaled"), six(cost.backoff_seconds(s % 8)).alias("wait"), F.coalesce(F.try_element_at(cost.ticks(s), F.lit(2)), F.when(s / 5 <= 8, 5).otherwise(10)).alias("tick"))


# --- orders, sets, reports ------------------------------------------------------------------------------------------

CELLS = "SELECT l_returnflag || l_linestatus AS model, (['uniform', 'random', 'hornet', 'f2cfull', 'f2c'])[l_linenumber % 5 + 1] AS sampler, CAST(1 + month(l_shipdate) AS INT) AS num_frames, count(*) AS n, count(*) FILTER (l_quantity > 25) AS good, count(*) FILTER (l_discount > 0.05) AS other FROM lineitem GROUP BY 1, 2, 3"


def line_cells(t) -> DataFrame:
    sampler = F.element_at(F.array(*map(F.lit, ("uniform", "random", "hornet", "f2cfull", "f2c"))), F.col("l_linenumber") % 5 + 1)
    return t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model"), sampler.alias("sampler"), (1 + F.month("l_shipdate")).cast("int").alias("num_frames")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("good"), F.count_if(F.col("l_discount") > 0.05).alias("other"))


RANK = "CASE sampler WHEN 'uniform' THEN 0 WHEN 'random' THEN 1 WHEN 'hornet' THEN 2 WHEN 'f2cfull' THEN 3 ELSE 4 END"


@query(f"WITH c AS (SELECT *, 10 * floor(10.0 * good / n) AS i, 10 * floor(10.0 * other / n) AS a FROM ({CELLS})), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY i DESC, {RANK}, num_frames DESC) AS ri, row_number() OVER (PARTITION BY model ORDER BY a DESC, {RANK}, num_frames DESC) AS ra FROM c) SELECT x.model, x.i AS I_Acc, y.a AS Acc, x.sampler || '-' || x.num_frames AS config, y.sampler || '-' || y.num_frames AS Acc_config FROM r x JOIN r y ON y.model = x.model AND y.ra = 1 WHERE x.ri = 1")
def best_configuration(t):
    c = line_cells(t).select("model", "sampler", "num_frames", (10 * F.floor(10 * F.col("good") / F.col("n"))).cast("double").alias("I_Acc"), (10 * F.floor(10 * F.col("other") / F.col("n"))).cast("double").alias("Acc"))
    return ranking.best_cell(c, ["model"])


@query(f"SELECT model, sampler, num_frames, CAST({RANK.replace('3 ELSE 4', '4 ELSE 5')} AS INT) AS sampler_rank FROM ({CELLS}) WHERE num_frames IN (1, 4, 8, 16, 24)")
def table_cells(t):
    return line_cells(t).where(F.col("num_frames").isin(1, 4, 8, 16, 24)).select("model", "sampler", "num_frames", ranking.sampler_rank(F.col("sampler")).alias("sampler_rank"))


METRICS = f"WITH c AS ({CELLS}), m AS (SELECT model, 'set' AS dataset, sampler, num_frames, n, good, other, good AS TP, n - good AS FP, other AS FN, n - other AS TN, n % 7 AS invalid FROM c WHERE num_frames IN (4, 8))"


@query(f"""{METRICS} SELECT model, dataset, sampler, num_frames, n AS n_items, n AS n_instances, round(100.0 * good / n, 6) AS I_Acc, {WILSON('good', 'n')[0]} AS I_Acc_lo, {WILSON('good', 'n')[1]} AS I_Acc_hi, round(50.0 * good / n, 6) AS Q_Acc, round(25.0 * good / n, 6) AS V_Acc, round(100.0 * other / n, 6) AS Acc, round(100.0 * (TP + FP) / (TP + FP + FN + TN), 6) AS yes_rate, TP, FP, FN, TN, invalid, round(100.0 * TP / (TP + FN), 6) AS sensitivity, round(100.0 * TN / (TN + FP), 6) AS specificity, round(100.0 * TP / (TP + FN) + 100.0 * TN / (TN + FP) - 100, 6) AS youden_J,
round((good / n - 0.0625) / sqrt(0.0625 * 0.9375 / n), 6) AS z_I_Acc_vs_chance, round((other / n - 0.5) / sqrt(0.25 / n), 6) AS z_Acc_vs_chance FROM m""")
def sweep_table(t):
    n = F.col("n")
    m = line_cells(t).withColumn("dataset", F.lit("set")).withColumn("I_Acc", F.col("good") / n).withColumn("Q_Acc", F.col("good") / n / 2).withColumn("V_Acc", F.col("good") / n / 4).withColumn("Acc", F.col("other") / n)
    m = m.withColumn("TP", F.col("good")).withColumn("FP", n - F.col("good")).withColumn("FN", F.col("other")).withColumn("TN", n - F.col("other")).withColumn("invalid", n % 7)
    out = reports.sweep_columns(m, n, n, n).drop("J_lo", "J_hi")
    return rounded(out, *(c for c in out.columns if dict(out.dtypes)[c] == "double"))


@query(f"WITH c AS ({CELLS}) SELECT model, sampler, " + ", ".join(f"max(good) FILTER (num_frames = {n}) AS good_{n}" for n in (4, 8, 12)) + " FROM c GROUP BY 1, 2")
def budget_series(t):
    return reports.series(line_cells(t), ["model", "sampler"], "num_frames", [4, 8, 12], "good")


@query(f"WITH c AS ({CELLS}) SELECT model, sampler, num_frames, 'good' AS metric, good AS value FROM c UNION ALL SELECT model, sampler, num_frames, 'other', other FROM c")
def sweep_long_form(t):
    return reports.long_form(line_cells(t).drop("n"), ["model", "sampler", "num_frames"], ["good", "other"])


@query(f"WITH c AS ({CELLS}), u AS (SELECT model, sampler, num_frames, n FROM c WHERE num_frames < 5 UNION ALL SELECT model, sampler, num_frames, n FROM c WHERE num_frames > 9 UNION ALL SELECT 'cited', 'none', 0, 56) SELECT CASE model WHEN 'AF' THEN 'Model A' ELSE model END AS model, sampler, CAST(num_frames AS INT) AS num_frames, CAST(n AS BIGINT) AS n FROM u")
def stacked_tables(t):
    c = line_cells(t).select("model", "sampler", "num_frames", "n")
    spark = c.sparkSession
    cited = spark.createDataFrame([("cited", "none", 0, 56)], "model string, sampler string, num_frames int, n long")
    shown = spark.createDataFrame([("AF", "Model A")], "model string, display string")
    return reports.stacked([c.where("num_frames < 5"), c.where("num_frames > 9"), cited], shown, [F.col("model"), ranking.sampler_rank(F.col("sampler")), F.col("num_frames")])


@query(f"WITH c AS (SELECT model, sampler, sum(good) AS r FROM ({CELLS}) GROUP BY 1, 2), b AS (SELECT max(r) AS best FROM c WHERE sampler <> 'uniform') SELECT model, sampler, CAST(r AS BIGINT) AS r, r = best AS r_best FROM c, b")
def best_marks(t):
    return reports.best_marks(line_cells(t).groupBy("model", "sampler").agg(F.sum("good").alias("r")), "sampler", "uniform", ["r"])


@query("WITH r AS (SELECT l_orderkey // 4 AS i, l_returnflag AS f, CASE WHEN l_linestatus = 'O' THEN 'none' WHEN l_linenumber % 2 = 0 THEN 'shuffled_frames' ELSE 'no_video' END AS ab, CAST(l_quantity > 10 AS INT) AS ok FROM lineitem), g AS (SELECT f, ab, i, bool_and(ok = 1) AS all_right, sum(ok) AS k, count(*) AS m FROM r GROUP BY 1, 2, 3) SELECT f AS model, CASE ab WHEN 'none' THEN 'ordered' WHEN 'no_video' THEN 'no-video' ELSE 'shuffled' END AS arm, count(*) AS n_instances, count(*) FILTER (all_right) AS n_right, CAST(sum(k) AS BIGINT) AS items_right, CAST(sum(m) AS BIGINT) AS n_items, round(100.0 * count(*) FILTER (all_right) / count(*), 6) AS I_Acc, round(100.0 * sum(k) / sum(m), 6) AS Acc, CAST(CASE ab WHEN 'none' THEN 0 WHEN 'no_video' THEN 3 ELSE 1 END AS INT) AS arm_rank FROM g GROUP BY f, ab")
def order_ablation(t):
    ab = F.when(F.col("l_linestatus") == "O", "none").when(F.col("l_linenumber") % 2 == 0, "shuffled_frames").otherwise("no_video")
    rows = t("lineitem").select(F.col("l_returnflag").alias("model"), F.lit("uniform").alias("strategy"), F.lit(16).alias("nframes"), ab.alias("ablation"), F.floor(F.col("l_orderkey") / 4).alias("instance_id"), F.col("l_linenumber").alias("index"), (F.col("l_quantity") > 10).cast("int").alias("correct"), F.lit("x").alias("category"))
    inst = scoring.strict_instances(rows, ["model", "strategy", "nframes", "ablation"])
    return rounded(reports.order_ablation(inst, ["model"]), "I_Acc", "Acc")


@query("SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS rate FROM events")
def running_accuracy(t):
    e = t("events").select("user_id", "event_id", (F.col("event_type") == "purchase").cast("double").alias("ok"))
    return rounded(ranking.running_mean(e, ["user_id"], "event_id", "ok", "rate").drop("ok"), "rate")


@query("WITH k AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2) SELECT user_id, event_type, first_at, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY first_at ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' '), '') AS next_keys FROM k")
def upcoming_keys(t):
    return ranking.next_distinct(t("events"), "user_id", "event_type", "event_id", 2).withColumn("next_keys", F.array_join("next_keys", " "))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, count(*) FILTER (value > 50) AS high FROM events WHERE props IS NOT NULL GROUP BY 1")
def realised_statistics(t):
    v = F.col("value")
    return t("events").where("props is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), six(F.min(v)).alias("lo"), six(F.max(v)).alias("hi"), F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_samp(v), 5).alias("sd"), F.count_if(v > 50).alias("high"))


@query("WITH w AS (SELECT event_type AS side, user_id AS word, sum(value) AS v FROM events GROUP BY 1, 2) SELECT side, word, round(coalesce((v - min(v) OVER (PARTITION BY side)) / nullif(max(v) OVER (PARTITION BY side) - min(v) OVER (PARTITION BY side), 0), 0), 5) AS weight FROM w")
def scaled_weights(t):
    w = Window.partitionBy("side")
    words = t("events").groupBy(F.col("event_type").alias("side"), F.col("user_id").alias("word")).agg(F.sum("value").alias("v"))
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return words.select("side", "word", F.round(F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)), 5).alias("weight"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def except_labelled(t):
    return t("documents").where("lang = 'en'").select("doc_id").subtract(t("labels").select("doc_id"))


def _sql_cache(renewed: str) -> str:
    """A cache of 300 bytes for each key, request by request; item n has 10 + n bytes. renewed: what a hit makes of `held`."""
    return f"""WITH RECURSIVE e AS (SELECT user_id % 5 AS key, event_id AS pos, CAST(event_id % 40 AS INT) AS n, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS k FROM events),
s AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, 0 AS n, CAST([] AS INT[]) AS held, false AS hit, CAST([] AS INT[]) AS gone FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, k, pos, n, CASE WHEN hit THEN {renewed} ELSE list_append(held[cut + 1:], n) END, hit, CASE WHEN hit THEN [] ELSE held[1:cut] END FROM (
SELECT e.key, e.k, e.pos, e.n, s.held, list_contains(s.held, e.n) AS hit, list_min(list_filter(range(0, len(s.held) + 1), lambda i: coalesce(list_sum(list_transform(s.held[i + 1:], lambda x: 10 + x)), 0) + 10 + e.n <= 300)) AS cut FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1))
SELECT CAST(key AS VARCHAR) AS key, pos, 'v' || n AS item, hit, NOT hit AS admitted, coalesce(array_to_string(list_transform(gone, lambda x: 'v' || x), ' '), '') AS evicted FROM s WHERE k > 0"""


def _requests(t) -> DataFrame:
    n = F.col("event_id") % 40
    return t("events").select((F.col("user_id") % 5).cast("string").alias("key"), F.col("event_id").alias("pos"), F.concat(F.lit("v"), n.cast("string")).alias("item"), (10 + n).alias("size"))


@query(_sql_cache("list_append(list_filter(held, lambda x: x <> n), n)"))
def cache_simulation(t):
    return incremental.cache_simulation(_requests(t), 300, "lru").withColumn("evicted", F.array_join("evicted", " "))


@query(_sql_cache("held"))
def fifo_memo(t):
    return incremental.cache_simulation(_requests(t), 300, "fifo").withColumn("evicted", F.array_join("evicted", " "))


@query("SELECT event_id, round(max(user_id % 50 - 0.5 * k) OVER (PARTITION BY event_type ORDER BY event_id) + 0.5 * k, 6) AS start FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)")
def gated_calls(t):
    calls = t("events").withColumn("at", (F.col("user_id") % 50).cast("double"))
    return work.gated(calls, ["event_type"], "at", "event_id", 0.5).select("event_id", six(F.col("start")).alias("start"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'd/' || p_partkey || '/v' WHEN p_partkey % 6 = 5 THEN 'd/' || p_partkey || ' /v ' END AS file FROM part")
def repaired_paths(t):
    k = F.col("p_partkey")
    blank = F.concat(F.lit("d/"), k.cast("string"), F.lit(" /v "))
    plain = F.concat(F.lit("d/"), k.cast("string"), F.lit("/v"))
    files = t("part").where("p_partkey % 3 < 2 or p_partkey % 6 = 5").select(F.when(k % 3 < 2, plain).otherwise(blank).alias("file"))
    rows = t("part").select("p_partkey", F.when(k % 3 == 0, plain).otherwise(blank).alias("path"))
    return work.repaired_paths(rows, files, "path").select("p_partkey", "file")


@query("SELECT CASE WHEN starts_with(event_type, 'c') THEN 'c' WHEN starts_with(event_type, 'p') THEN 'p' ELSE 'other' END AS part, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS size FROM events GROUP BY 1")
def groups_by_prefix(t):
    return work.by_prefix(t("events"), "event_type", "user_id", ["c", "p"])


@query("SELECT user_id AS video, CASE WHEN user_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, CAST(3 AS INT) AS total, CASE WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN CAST(user_id AS DOUBLE) END AS first_number FROM (SELECT DISTINCT user_id FROM events)")
def cached_embeddings(t):
    wanted = t("events").select(F.col("user_id").alias("video")).distinct().select("video", F.when(F.col("video") % 2 == 0, "m1").otherwise("m2").alias("model"), F.lit(3).alias("total"))
    # The cache holds vectors of one model only, an old version of each, and broken entries for all but every third.
    vectors_of = lambda x: F.array(F.array(x), F.array(x), F.array(x))
    now = F.when(F.col("video") % 3 == 0, vectors_of(F.col("video").cast("double"))).otherwise(F.array(F.array(F.lit(0.0))))
    old = F.when(F.col("video") % 3 == 0, vectors_of(F.lit(-1.0))).otherwise(F.array(F.array(F.lit(0.0))))
    entry = lambda e, at: wanted.select("video", F.lit("m1").alias("model"), "total", e.alias("embeddings"), F.lit(at).alias("written"))
    kept = staging.written(entry(old, 1).unionByName(entry(now, 2)), staging.new_path(wanted.sparkSession, "embedding-cache"))
    return work.with_cached(wanted, kept).select("video", "model", "total", F.col("embeddings")[0][0].alias("first_number"))


@query("SELECT conv_id, turn, n FROM conversations JOIN (SELECT conv_id, 10 * conv_id AS n FROM conversations GROUP BY 1) USING (conv_id)")
def work_once_a_key(t):
    return work.once_a_key(t("conversations").select("conv_id", "turn"), ["conv_id"], lambda keys: keys.withColumn("n", 10 * F.col("conv_id")))


@query()
def display_rounding(t):
    x = F.col("l_extendedprice") * F.col("l_discount") / 100
    return t("lineitem").select("l_orderkey", "l_linenumber", pythonic.fixed(x, 1).alias("shown"), pythonic.python_round(x, 2).alias("rounded"))


@query(f"WITH p AS ({PREDICTED}), c AS (SELECT {CONFUSION} FROM p) SELECT 'TP=' || TP || ' FP=' || FP || ' FN=' || FN || ' TN=' || TN || ' invalid=' || invalid || chr(10) || CASE WHEN (TP + TN) / (TP + FP + FN + TN) BETWEEN 0.4 AND 0.6 THEN 'yes/no accuracy near chance' ELSE 'yes/no accuracy lies outside 40 to 60 percent' END AS report FROM c")
def console_report(t):
    return reports.report_text(scoring.confusion(label_predictions(t), F.col("g"), F.col("s"))).select("report")


@query(f"""WITH c AS (SELECT *, 10 * floor(10.0 * good / n) AS i, 10 * floor(10.0 * other / n) AS a FROM ({CELLS})), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY i DESC, {RANK}, num_frames DESC) AS ri, row_number() OVER (PARTITION BY model ORDER BY a DESC, {RANK}, num_frames DESC) AS ra FROM c),
t AS (SELECT l_returnflag || l_linestatus AS model, max(l_tax) AS tb FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), v AS (SELECT 'AF' AS model, 0.5::DOUBLE AS tb UNION ALL SELECT 'NO', 0.7)
SELECT x.model, x.i AS I_Acc, y.a AS Acc, x.sampler || '-' || x.num_frames AS config, y.sampler || '-' || y.num_frames AS Acc_config, coalesce(t.tb, v.tb) AS tb, CASE WHEN t.tb IS NOT NULL THEN 'measured' WHEN v.tb IS NOT NULL THEN 'cited' END AS tb_source FROM r x JOIN r y ON y.model = x.model AND y.ra = 1 LEFT JOIN t ON t.model = x.model LEFT JOIN v ON v.model = x.model WHERE x.ri = 1""")
def leaderboard(t):
    c = line_cells(t).select("model", "sampler", "num_frames", (10 * F.floor(10 * F.col("good") / F.col("n"))).cast("double").alias("I_Acc"), (10 * F.floor(10 * F.col("other") / F.col("n"))).cast("double").alias("Acc"))
    tb = t("lineitem").where("l_linestatus = 'O'").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(F.max("l_tax").alias("tb"))
    cited = c.sparkSession.createDataFrame([("AF", 0.5), ("NO", 0.7)], "model string, tb double")
    return reports.leaderboard(c, [(tb, ["tb"])], cited)


@query("SELECT o_orderpriority AS category, count(DISTINCT o_orderkey // 4) AS n_instances, count(DISTINCT o_custkey) AS n_clips, count(*) AS n_items FROM orders GROUP BY 1")
def dataset_makeup(t):
    return reports.makeup(t("orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("video_path")))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Look closely. ' || text || ' Think first.' WHEN 1 THEN text ELSE text END AS prompt, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'Order matters.' ELSE '' END AS system FROM conversations")
def templated_prompts(t):
    rows = t("conversations").select("conv_id", "turn", F.col("text").alias("question"), F.element_at(F.array(F.lit("cot"), F.lit("bare"), F.lit("unknown")), (F.col("turn") % 3 + 1).cast("int")).alias("template"))
    templates = rows.sparkSession.createDataFrame([("cot", "Look closely. {question} Think first.", None), ("bare", "{question}", "Order matters.")], "name string, text string, system string")
    return joins.templated(rows, templates).select("conv_id", "turn", "prompt", "system")


@query("SELECT c_custkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s_name WHEN c_custkey % 2 = 0 THEN c_name END AS path, CASE WHEN s.s_suppkey IS NOT NULL THEN 'local' WHEN c_custkey % 2 = 0 THEN 'remote' END AS origin FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey")
def resolved_paths(t):
    rows = t("customer").select("c_custkey")
    local = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("path"))
    remote = t("customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("path"))
    return joins.resolved(rows, local, remote, "c_custkey")


@query("WITH a AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS p FROM events WHERE event_type <> 'error'), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS p FROM orders) SELECT event_id, o_orderkey FROM a JOIN b USING (p)")
def side_by_side(t):
    a = t("events").where("event_type <> 'error'").select("event_id")
    b = t("orders").select("o_orderkey", (-F.col("o_orderkey")).alias("back"))
    return joins.by_position(a, b, "event_id", "back").drop("back")


@query("SELECT event_type, count(*) AS n_calls, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost, count(*) FILTER (event_id % 13 = 0) AS n_failed FROM events GROUP BY 1")
def call_spending(t):
    calls = t("events").select("event_type", F.col("user_id").alias("tokens"), F.col("value").alias("cost"), F.when(F.col("event_id") % 13 == 0, "429").otherwise(" ").alias("error"))
    return reports.spending(calls, ["event_type"]).withColumn("cost", F.round("cost", 4))


@query("SELECT r_regionkey, r_name FROM region")
def checked_size(t):
    return joins.checked_size(t("region"), 5).select("r_regionkey", "r_name")
