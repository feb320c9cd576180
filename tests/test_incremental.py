"""Streams that resume, ask again, and stop in time; the model's plug point."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumenquad.sources import sinks
from lumenquad.sources.versions import VersionedTable
from lumenquad.streaming import incremental
from lumenquad.streaming.incremental import answered_stream, results

SCHEMA = "index long, video_path string, question string"


class Bench:
    """A stream of files, a sink and a record of what was asked."""

    def __init__(self, spark, path):
        self.spark, self.path, self.asked = spark, path, []

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, fails=(), **more):
        def answer(df):
            self.asked.append(sorted((r["index"], r.video_path) for r in df.select("index", "video_path").collect()))
            bad = F.col("index").isin(*fails, -1)
            return df.withColumns({"model_output": F.when(bad & (F.col("index") % 2 == 0), " ").when(~bad, F.upper("question")), "error": F.when(bad & (F.col("index") % 2 == 1), "boom")})

        items = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        return answered_stream(items, answer, f"{self.path}/out", f"{self.path}/marks", **more)

    def rows(self):
        return sorted((r["index"], r.video_path, r.model_output, r.error) for r in results(self.spark, f"{self.path}/out").collect())


def test_failures_are_asked_again(spark, tmp_path):
    b = Bench(spark, tmp_path)
    b.add((0, "a", "x"), (1, "a", "y"), (2, "a", "z"), (2, "b", "zz"))
    first = b.run(fails=[1, 2])
    assert (first.batches, first.finished) == (1, True)
    assert b.rows() == [(0, "a", "X", None), (1, "a", None, "boom"), (2, "a", " ", None), (2, "b", " ", None)]
    b.add((0, "a", "x"), (3, "a", "w"), (1, "a", "y"))
    b.run(fails=[2])
    # What failed comes first, each item by index and path; then what is new, without what is answered by now.
    assert b.asked[1:] == [[(1, "a"), (2, "a"), (2, "b")], [(3, "a")]]
    assert b.run().batches == 1 and b.rows() == [(0, "a", "X", None), (1, "a", "Y", None), (2, "a", "Z", None), (2, "b", "ZZ", None), (3, "a", "W", None)]
    assert b.run().batches == 0 and len(b.asked) == 4


def test_a_failure_after_an_answer_does_not_count(spark, tmp_path):
    b = Bench(spark, tmp_path)
    b.add((0, "a", "x"))
    b.run()
    table = VersionedTable(spark, str(tmp_path / "out"))
    table.append(*table.put(spark.createDataFrame([(0, "a", "x", None, "late")], SCHEMA + ", model_output string, error string")))
    assert b.rows() == [(0, "a", "X", None)] and b.run().batches == 0


def test_cut_runs_give_what_a_whole_one_gives(spark, tmp_path):
    cut, whole = Bench(spark, tmp_path / "cut"), Bench(spark, tmp_path / "whole")
    for b in (cut, whole):
        for k in range(5):
            b.add((2 * k, "a", f"q{k}"), (2 * k + 1, "a", f"r{k}"), (0, "a", "q0"))
    now = iter(range(100))
    tick = lambda: next(now)
    first = cut.run(seconds=0, clock=tick)
    assert (first.batches, first.finished, len(cut.asked)) == (1, False, 1)
    second = cut.run(seconds=2, clock=tick)  # the clock is looked at before each batch but a run's first
    assert not second.finished and second.batches == 2 and len(cut.asked) == 3
    last = cut.run()
    assert last.finished and last.batches == 2
    assert whole.run(seconds=3600).finished and cut.rows() == whole.rows() and len(cut.rows()) == 10
    assert sinks.current(spark, str(tmp_path / "cut/out")).count() == 10


def test_a_batch_published_before_a_crash_counts_once(spark, tmp_path):
    b = Bench(spark, tmp_path)
    b.add((0, "a", "x"))
    append = VersionedTable.append

    def crash(self, *args, **more):
        append(self, *args, **more)
        raise RuntimeError("gone")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(VersionedTable, "append", crash)
        with pytest.raises(StreamingQueryException):
            b.run()
    b.add((1, "a", "y"))
    b.run()
    assert sinks.current(spark, str(tmp_path / "out")).count() == 2 and b.asked == [[(0, "a")], [(1, "a")]]
    with pytest.raises(FileNotFoundError):
        results(spark, str(tmp_path / "nothing"))


def test_one_bad_item_of_a_batch(spark):
    items = spark.createDataFrame([(i, "a", f"q{i}") for i in range(100)], SCHEMA).coalesce(1)

    def call(word, rows):
        if rows["index"].isin([17, 18, 63]).any() and word == "first":
            raise KeyError("frames")
        return rows.question + word

    got = {r["index"]: (r.model_output, r.error) for r in incremental.predicted(items, lambda: "first", call).collect()}
    assert {i for i, (_, e) in got.items() if e} == {17, 18, 63} and got[17] == (None, "KeyError: 'frames'")
    assert all(got[i] == (f"q{i}first", None) for i in got if i not in (17, 18, 63))
    previous = incremental.predicted(items, lambda: "first", call).cache()
    again = {r["index"]: r.model_output for r in incremental.predicted_again(items.where("index > 9"), previous, lambda: "then", call).collect()}
    assert len(again) == 90 and {i for i, x in again.items() if x.endswith("then")} == {17, 18, 63}
    short = incremental.predicted(items.limit(2), lambda: None, lambda m, rows: rows.question[:1]).collect()
    assert [r.model_output for r in short] == ["q0", "q1"]
    assert incremental.predicted(items.limit(0), lambda: None, call).count() == 0
