"""Files in, files out."""

import json

from pyspark.sql import functions as F

from lumenquad import schemas
from lumenquad.sources import readers, sinks


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_arrays_and_lines(spark, tmp_path):
    rows = [{"index": i, "video_path": f"v{i}", "question": "q", "answer": " Yes ", "type": None, "extra": 1} for i in range(3)]
    write(tmp_path / "d/a.json", rows)
    write(tmp_path / "d/b.jsonl", "\n".join(json.dumps(r | {"index": r["index"] + 10, "type": "multiple_choice_4"}) for r in rows) + "\n\n")
    write(tmp_path / "d/c.json", "")
    got = readers.truth(spark, str(tmp_path / "d"))
    assert sorted((r["index"], r.answer, r.type) for r in got.collect()) == [*((i, "yes", "yes_no") for i in range(3)), *((i, "yes", "mcq4") for i in range(10, 13))]
    assert sorted((r._file, r._pos) for r in readers.json_rows(spark, str(tmp_path / "d/a.json"), schemas.ITEM).collect()) == [("a.json", i) for i in range(3)]


def test_predictions(spark, tmp_path):
    flat = [{"index": 0, "model_output": "yes", "strategy": "uniform", "seed": 1}]
    nested = [{"index": 1, "model_output": "no", "frames": {"strategy": "random", "seed": 2}, "frame_indices": [3, 4]}]
    for name, rows in {"m_s_uniform8.json": flat, "m_s_random4_shuf7.json": nested, "_m_s_uniform8.json": flat, "m_s_uniform8_metrics.json": flat, "m_smoke_s_uniform8.json": flat, "m_s_uniform16.json": "{broken", "m_s.json": flat}.items():
        write(tmp_path / name, rows)
    got = sorted((r.sampler, r.num_frames, r.ablation, r["index"], r.strategy, r.seed) for r in readers.predictions(spark, str(tmp_path)).collect())
    assert got == [("random", 4, "shuffled_frames", 1, "random", 2), ("uniform", 8, "none", 0, "uniform", 1)]


def test_selections_and_metrics(spark, tmp_path):
    write(tmp_path / "sel/uniform4.json", {"meta": {"sampler": "uniform"}, "items": {"videos/a.mp4": {"indices": [0, 5]}, "7": {"indices": [1], "scales": [1.5]}}})
    write(tmp_path / "sel/notes.json", {"items": {"x": {"indices": [1]}}})
    got = {(r.sampler, r.num_frames, r.key): (r.indices, r.scales) for r in readers.selections(spark, str(tmp_path / "sel")).collect()}
    assert got == {("uniform", 4, "videos/a.mp4"): ([0, 5], None), ("uniform", 4, "7"): ([1], [1.5])}
    write(tmp_path / "met/m_uniform8_metrics.json", {"I_Acc": 0.5, "confusion": {"TP": 1, "FP": 2, "FN": 3, "TN": 4, "invalid": 0}})
    write(tmp_path / "met/m_hornet16_full_pool64_metrics.json", {"I_Acc": 0.25})
    write(tmp_path / "met/mm_uniform8_metrics.json", {"I_Acc": 0.75})
    got = {(r.sampler, r.num_frames, r.variant): r.I_Acc for r in readers.quad_metrics(spark, str(tmp_path / "met"), "m").collect()}
    assert got == {("uniform", 8, ""): 0.5, ("hornet", 16, "full_pool64"): 0.25}
    write(tmp_path / "mcq/m_uniform8_metrics.json", {"Acc_pct": 50.0, "config": {"ablation": "none"}, "by_duration": {"short": {"Acc_pct": 1.0}}})
    write(tmp_path / "mcq/m_uniform4_metrics.json", {"Acc_pct": 40.0, "config": {"ablation": "no_video"}})
    assert [r.Acc_pct for r in readers.mcq_metrics(spark, str(tmp_path / "mcq"), "m").collect()] == [50.0]


def test_tables(spark, tmp_path):
    write(tmp_path / "q.csv", 'strategy,nframes,ablation,index,gold,correct\nuniform,8,none,0,yes,1\nuniform,8,none,0,yes,1\nnone,,no_video,1,"a ""b""",0\nnative,,none,2,no,0\n')
    rows = readers.combined_cells(spark, str(tmp_path / "q.csv")).collect()
    assert sorted((r.strategy, r.nframes, r["index"], r.gold) for r in rows) == [("none", 0, 1, 'a "b"'), ("uniform", 8, 0, "yes"), ("uniform", 8, 0, "yes")]
    assert readers.per_question(spark, str(tmp_path / "q.csv")).where("nframes = 8").count() == 1
    write(tmp_path / "s.csv", "model,dataset,sampler,num_frames,I_Acc,Acc,ablation\nm,d,uniform,8,1.5,50,\nm,d,uniform,16,,50,none\nm,d,uniform,4,2,50,no_video\nm,e,uniform,4,2,50,none\n")
    assert [(r.num_frames, r.I_Acc) for r in readers.sweep(spark, str(tmp_path / "s.csv"), "d").collect()] == [(8, 1.5)]
    df = readers.first_readable([lambda: spark.read.parquet(str(tmp_path / "absent")), lambda: readers.csv_rows(spark, str(tmp_path / "s.csv"))])
    assert df.count() == 4
    files = spark.createDataFrame([("1.zip", "d/a.MP4", 1), ("2.zip", "e/a.mp4", 2), ("1.zip", "b.txt", 1)], "zip string, member string, size long")
    assert [tuple(r) for r in readers.archive_members(files).collect()] == [("a", "2.zip", "e/a.mp4", 2)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.when(F.col("id") > 3, F.col("id") * 2))
    path = str(tmp_path / "t")
    assert sinks.replace_unless_smaller(df, path) and not sinks.replace_unless_smaller(df.limit(3), path)
    assert sinks.current(spark, path).count() == 10 and sinks.replace_unless_smaller(df.union(df), path) and sinks.current(spark, path).count() == 20
    sinks.pretty_json(df.limit(2), str(tmp_path / "x.json"))
    assert len(json.loads((tmp_path / "x.json").read_text())) == 2
    sinks.table_csv(df, str(tmp_path / "csv"))
    sinks.json_lines(df, str(tmp_path / "lines"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("v is null").count() == 4 and spark.read.json(str(tmp_path / "lines")).count() == 10
    facts = spark.createDataFrame([("uniform", 8, "none", 0, [1, 2], [1.5]), ("none", 0, "no_video", 1, [], None)], "strategy string, nframes int, ablation string, index long, frame_indices array<int>, f2c_scales array<double>")
    sinks.cells(facts, str(tmp_path / "cells"))
    assert {r.frame_indices for r in spark.read.csv(str(tmp_path / "cells"), header=True).collect()} == {"1 2", None}
    assert {r.file for r in sinks.cell_names(facts, "m", "d").collect()} == {"m_d_per_question_uniform8.csv", "m_d_per_question_no_video.csv"}
    assert json.loads(sinks.metrics_json(spark.createDataFrame([("m", 1.5)], "model string, Acc double"), ["model"]).first().document) == {"Acc": 1.5, "_derived": True}
