"""Scoring, joins, rankings, segments and plans on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquad.functions import text
from lumenquad.operators import joins, ranking, scoring, segments, vectors
from lumenquad.plans import reports
from lumenquad.streaming import incremental


def quads_of(spark, rows):
    df = spark.createDataFrame(rows, "index long, pos long, code int")
    return {r.instance_id: tuple(r)[1:] for r in scoring.quads(df).collect()}


def test_quads_complete_partial_and_repeated(spark):
    rows = [(0, 0, 1), (1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 1), (5, 5, 0), (6, 6, 0), (8, 7, 0), (8, 8, 1), (9, 9, -1), (10, 10, 0), (11, 11, 1), (12, 12, None), (13, 13, 0), (14, 14, 0), (15, 15, 1)]
    assert quads_of(spark, rows) == {0: (1, 0, 0, 1), 1: (-1,) * 4, 2: (1, -1, 0, 1), 3: (-1,) * 4}


def test_rates_hold_their_bounds_and_are_blind_to_order(spark):
    r = random.Random(5)
    rows = [(i, r.choice([1, 0, 0, 1, -1])) for i in range(400)]
    get = lambda x: scoring.quad_rates(scoring.quads(spark.createDataFrame([(i, i, c) for i, c in x], "index long, pos long, code int"))).first()
    a = get(rows)
    r.shuffle(rows)
    b = get(rows)
    assert a == b and a.I_Acc <= min(a.Q_Acc, a.V_Acc) and max(a.Q_Acc, a.V_Acc) <= a.Acc
    constant = get([(i, 1) for i in range(80)])
    assert (constant.Acc, constant.I_Acc) == (0.5, 0)
    assert scoring.quad_rates(scoring.quads(spark.createDataFrame([], "index long, pos long, code int"))).first().Acc == 0


def test_answers_meet_their_items(spark):
    p = spark.createDataFrame([(0, 0, "Yes."), (1, 1, "no"), (2, 2, ""), (3, 3, "A"), (9, 4, "yes")], "index long, pos long, model_output string")
    items = spark.createDataFrame([(0, "yes_no"), (1, "yes_no"), (2, "mcq4"), (3, "mcq4")], "index long, type string")
    assert {r["index"]: r.code for r in scoring.answered(p, items).collect()} == {0: 1, 1: 0, 2: -1, 3: None, 9: None}


def test_confusion_without_valid_rows(spark):
    df = spark.createDataFrame([(1, -1), (0, -1)], "g int, s int")
    r = scoring.confusion(df, F.col("g"), F.col("s")).first()
    assert (r.TP, r.FP, r.FN, r.TN, r.invalid, r.Acc, r.F1, r.n_yesno_valid, r.n_yesno_total) == (0, 0, 0, 0, 2, 0, 0, 0, 2)


def test_multiple_choice(spark):
    items = spark.createDataFrame([(i, a, ["A. red fish", "B. blue bird", "C. green frog", "D. grey wolf"], d, "t") for i, a, d in ((0, "A", "short"), (1, "b", "long"), (2, "C", ""), (3, "D", "long"))], "index long, answer string, options array<string>, duration string, task_type string")
    p = spark.createDataFrame([(0, "A."), (1, "the blue bird"), (2, "???"), (3, None), (7, "A")], "index long, model_output string")
    coded = scoring.mcq_coded(p, items)
    s = scoring.mcq_scores(coded).first()
    assert (s.n, s.correct, s.invalid, s.majority_letter, s.chosen_A, s.chosen_B) == (4, 2, 2, "A", 1, 1)
    got = {(r.grouping, r.value): (r.n, r.correct) for r in scoring.mcq_by_group(coded, ["duration", "task_type"]).collect()}
    assert got == {("all", None): (4, 2), ("duration", "short"): (1, 1), ("duration", "long"): (2, 1), ("task_type", "t"): (4, 2)}


def test_paired(spark):
    a = spark.createDataFrame([(i, int(i < 8)) for i in range(10)], "k int, right int")
    b = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "k int, right int")
    r = scoring.paired(a, b, "k").first()
    assert (r.n, r.both, r.only_a, r.only_b, r.neither) == (10, 4, 4, 1, 1) and r.p_value == pytest.approx(2 * (1 + 5) / 32)


def test_resume_and_merge(spark):
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "index long, video_path string")
    old = spark.createDataFrame([(0, "a", "yes", None), (1, "x", "yes", None), (2, "c", "  ", None), (3, "d", "yes", "boom")], "index long, video_path string, model_output string, error string")
    assert {r["index"] for r in joins.to_do(items, old).collect()} == {1, 2, 3}
    merged = joins.merged_results(joins.done_rows(old), spark.createDataFrame([(1, "new")], "index long, model_output string"))
    assert {(r["index"], r.model_output) for r in merged.collect()} == {(0, "yes"), (1, "new")}


def test_best_cell_ties(spark):
    cells = spark.createDataFrame([("m", "random", 8, 10.0, 50.0), ("m", "uniform", 4, 10.0, 40.0), ("m", "uniform", 8, 10.0, 41.0), ("m", "hornet", 24, 9.0, 60.0)], "model string, sampler string, num_frames int, I_Acc double, Acc double")
    assert tuple(ranking.best_cell(cells, ["model"]).first()) == ("m", 10.0, 60.0, "uniform-8", "hornet-24")


def test_dense_index_keeps_wide_rows(spark):
    """Wide and narrow runs of one adaptive shuffle have unlike parts."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        wide = spark.range(120_000, numPartitions=8).withColumn("pay", F.repeat(F.sha2(F.col("id").cast("string"), 256), 16))
        got = ranking.dense_index(wide, "id")
        assert got.agg(F.count("*"), F.count_if(F.col("id") == F.col("index")), F.max(F.length("pay"))).first() == (120_000, 120_000, 1024)
        both = joins.by_position(wide.withColumnRenamed("pay", "a"), wide.select((-F.col("id")).alias("back"), "pay"), "id", "back")
        assert both.agg(F.count("*"), F.sum(F.col("id") - F.col("back"))).first() == (120_000, 120_000 * 119_999)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dense_index_and_prefix(spark):
    df = spark.createDataFrame([(i * 7, i != 31) for i in range(100)], "pos long, done boolean").repartition(7)
    assert [(r.pos, r["index"]) for r in ranking.dense_index(df, "pos").orderBy("pos").collect()] == [(i * 7, i) for i in range(100)]
    assert ranking.finished_prefix(df, "pos", "done").count() == 31


def brute_peaks(s):
    n = len(s)
    if n == 1:
        return [0]
    v = sorted({0, n - 1, *(i for i in range(1, n - 1) if s[i] <= s[i - 1] and s[i] <= s[i + 1])})
    return sorted({a + int(np.argmax(s[a : b + 1])) for a, b in itertools.pairwise(v)})


def test_peaks_equal_plain_python(spark):
    r = random.Random(2)
    series = [[1.0], [1.0, 2.0], [3, 2, 1], [1, 1, 1, 1], [0, 5, 0, 5, 0], *([r.randrange(5) for _ in range(r.randrange(1, 30))] for _ in range(40))]
    df = spark.createDataFrame([(k, i, float(x)) for k, s in enumerate(series) for i, x in enumerate(s)], "key long, pos long, score double")
    got = {}
    for x in segments.basin_peaks(df).collect():
        got.setdefault(x.key, []).append(x.pos)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_peaks([float(x) for x in s]) for k, s in enumerate(series)}


def test_intervals_merge(spark):
    rows = [("k", "1", 0, 3, 2.0), ("k", "1", 3, 5, 1.5), ("k", "1", 7, 9, 1.0), ("k", "2", 0, 3, 1.0), ("k", "1", 1, 2, 3.0)]
    df = spark.createDataFrame(rows, "key string, s_key string, lo int, hi int, s double").withColumn("idxs", F.array("lo", "hi"))
    got = {(r.s_key, r.lo, r.hi, r.n_merged, r.s, tuple(r.idxs)) for r in segments.merged(df, ["key", "s_key"], members="idxs", value="s").collect()}
    assert got == {("1", 0, 5, 3, 1.5, (0, 1, 2, 3, 5)), ("1", 7, 9, 1, 1.0, (7, 9)), ("2", 0, 3, 1, 1.0, (0, 3))}
    assert segments.merged(df.limit(0), ["key"]).count() == 0


def test_clusters_and_segments(spark):
    own = segments.kmeans_1d(np.array([0, 1, 2, 50, 51, 99, 100]), 3, np.random.default_rng(0))
    assert len(set(own[:3])) == len(set(own[3:5])) == len(set(own[5:])) == 1 and len(set(own)) == 3
    r = np.random.default_rng(1)
    two = np.concatenate([r.normal((0.1, 0.5), 0.02, (30, 2)), r.normal((0.8, 0.5), 0.02, (30, 2))])
    lobes = segments.two_lobes(two)
    assert len(set(lobes[:30])) == 1 and lobes[0] != lobes[40] and segments.two_lobes(two[:30]) is None and segments.two_lobes(two[:10]) is None
    rows = [("a", i, float(i % 9), i * 25, [float(x) for x in r.normal(size=4)]) for i in range(40)]
    plan = segments.segment(spark.createDataFrame(rows, "key string, pos int, score double, video_index int, embedding array<float>"), 4).collect()
    assert plan and all(1 <= x.scale <= 2 and x.frame % 25 == 0 for x in plan) and len({x.frame for x in plan}) == len(plan)


def test_similarity(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(7, 5))
    df = spark.createDataFrame([(0, [float(x) for x in row]) for row in v], "g int, e array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert vectors.mean_pair_similarity(df, "g", "e").first().mean_similarity == pytest.approx((s.sum() - np.trace(s)) / 42)
    assert df.select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c == 0


def test_fact_rows_and_metrics(spark):
    truth = spark.createDataFrame([(i, f"videos/0{1 + i // 4}_00_0.mp4", f"q{i}", "yes" if i % 4 in (0, 3) else "no", "yes_no", None, None, None) for i in range(8)], "index long, video_path string, question string, answer string, type string, options array<string>, duration string, task_type string")
    said = ["Yes", "No.", "no", "yes", "yes", "Yes", None, "no way"]
    p = spark.createDataFrame([("uniform", 8, "none", "f.json", i, None, said[i], None) for i in range(8)], "sampler string, num_frames int, ablation string, pred_file string, index long, video_path string, model_output string, error string")
    picks = spark.createDataFrame([("uniform", 8, "videos/01_00_0.mp4", [1, 2], None), ("uniform", 8, "5", [9], None), ("random", 8, "5", [0], None)], "sampler string, num_frames int, key string, indices array<int>, scales array<double>")
    facts = reports.fact_rows(p, truth, picks)
    got = {r["index"]: (r.extracted, r.correct, r.instance_id, r.frame_indices) for r in facts.collect()}
    assert got == {0: ("yes", 1, 0, [1, 2]), 1: ("no", 1, 0, [1, 2]), 2: ("no", 1, 0, [1, 2]), 3: ("yes", 1, 0, [1, 2]), 4: ("yes", 1, 1, None), 5: ("yes", 0, 1, [9]), 6: ("", 0, 1, None), 7: ("no", 0, 1, None)}
    m = reports.quad_metrics(facts, ["strategy", "nframes", "ablation"]).first()
    assert (m.I_Acc, m.Acc, m.TP, m.FP, m.FN, m.TN, m.invalid) == (0.5, 5 / 8, 3, 1, 1, 2, 1)
    export = facts.withColumn("gold", F.when(F.col("index") == 3, "no").otherwise(F.col("gold")))
    checked = reports.checked_export(export.drop("type", "code"), truth)
    assert [r["index"] for r in checked.where("mismatch").collect()] == [3] and checked.where("correct = 1").count() == 5


def test_preparation(spark):
    rows = [(i, "Short " if i % 2 else "", f"v{i // 3}", f"q{i}", ["a", "b", "c", "d"], " B ") for i in range(12)]
    raw = spark.createDataFrame(rows, "pos long, duration string, video_id string, question_id string, options array<string>, answer string")
    index = spark.createDataFrame([("v0",), ("v1",)], "video_id string")
    got = reports.prepared_mcq(raw, ["short"], index, most_videos=3, require_video=True).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(6)) and got[0].answer == "B" and got[5].video_path == "videos/v1.mp4"
    bad = raw.withColumn("options", F.slice("options", 1, 3))
    with pytest.raises(Exception, match="expected 4 options"):
        reports.prepared_mcq(bad, ["short"]).collect()


def test_runs_by_file_name(spark):
    names = ["gpt_5_hi_main_uniform8_rev.json", "/x/gpt_5_main_random4.json", "gpt_5_zzz_random4.json", "other_main_random4.json", "gpt_55_main_random4.json", "gpt_5.json", "gpt_5__m_uniform8_full_pool4.json", "", None]
    files = spark.createDataFrame([(n, 1) for n in [*names, names[0]]], "file string, more int")
    subjects = spark.createDataFrame([("gpt_5", "GPT"), ("gpt_5_hi", "GPT-high"), ("gpt_5", "later")], "token string, folder string")
    datasets = spark.createDataFrame([("main", "MAIN"), ("m", "MAIN"), ("m", "MAIN")], "token string, dataset string")
    got = joins.runs_of(files, subjects, datasets).select("file", "subject", "folder", "dataset", "prefix", "more").collect()
    assert sorted(map(tuple, got)) == sorted([
        *[(names[0], "gpt_5_hi", "GPT-high", "MAIN", "gpt_5_hi_main", 1)] * 2, (names[1], "gpt_5", "GPT", "MAIN", "gpt_5_main", 1), (names[6], "gpt_5", "GPT", "MAIN", "gpt_5__m", 1),
    ])


def test_size_guard(spark):
    assert joins.checked_size(spark.range(3), 3).count() == 3
    with pytest.raises(Exception, match="expected 4 rows, got 3"):
        joins.checked_size(spark.range(3), 4)


def test_cache_simulation(spark):
    r = spark.createDataFrame([("k", i, x, 4) for i, x in enumerate("abcab")], "key string, pos long, item string, size int")
    run = lambda policy: [(x.item, x.hit, x.evicted) for x in incremental.cache_simulation(r, 8, policy).orderBy("pos").collect()]
    assert run("lru") == [("a", False, []), ("b", False, []), ("c", False, ["a"]), ("a", False, ["b"]), ("b", False, ["c"])]
    assert run("keep") == [("a", False, []), ("b", False, []), ("c", False, []), ("a", True, []), ("b", True, [])]
