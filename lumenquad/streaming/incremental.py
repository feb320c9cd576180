"""Incremental runs on Structured Streaming, and order-dependent simulations.

A run answers what arrived since the last one and what failed in it. Its state is the sink itself, a table of versions: a
micro-batch leaves out what a finished row there answers, and is one version, so that a batch that is repeated after a
crash counts once. The checkpoint holds how far the source was read.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import joins
from ..sources.versions import Version, VersionedTable

Call = Callable[[object, pd.DataFrame], pd.Series]


def _answers(model: object, call: Call, rows: pd.DataFrame) -> Iterator[tuple[object, str | None]]:
    """An answer or an error a row. A batch that fails is halved until the rows that fail stand alone."""
    try:
        out = list(call(model, rows))
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} answers to {len(rows)} items")
        yield from ((x, None) for x in out)
    except Exception as e:  # noqa: BLE001 - kept as the row's error
        if len(rows) == 1:
            yield None, f"{type(e).__name__}: {e}"
        else:
            half = len(rows) // 2
            yield from _answers(model, call, rows.iloc[:half])
            yield from _answers(model, call, rows.iloc[half:])


def predicted(items: DataFrame, load: Callable[[], object], call: Call) -> DataFrame:
    """items with model_output and error of a model that each task loads once.

    An item that fails is an error in its own row; the others of its batch are answered (asked again, in halves).
    """
    schema = T.StructType([*items.schema.fields, T.StructField("model_output", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            found = list(_answers(model, call, b)) if len(b) else []
            yield b.assign(model_output=[None if x is None or x != x else str(x) for x, _ in found], error=[e for _, e in found])

    return items.mapInPandas(run, schema)


def predicted_again(items: DataFrame, previous: DataFrame, load: Callable[[], object], call: Call, keys: list[str] | None = None) -> DataFrame:
    """The finished rows of an earlier run as they are, and all other items asked now.

    previous: what predicted() gave, as it was written; rows of items that are no longer asked for are left out.
    """
    keys = keys or ["index", "video_path"]
    kept = joins.done_rows(previous).dropDuplicates(keys).join(items.select(*keys).distinct(), keys, "left_semi")
    return predicted(joins.to_do(items, previous, keys), load, call).unionByName(kept.select(*items.columns, "model_output", "error"))


@dataclass
class Run:
    #: Batches that this run has put into the sink, the one of repeated items among them.
    batches: int
    #: Whether all that had arrived is answered; if not, the time was up and the next run goes on.
    finished: bool


class _TimeIsUpError(RuntimeError):
    pass


def answered_stream(
    items: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str] | None = None,
    seconds: float | None = None, clock: Callable[[], float] = time.monotonic,
) -> Run:
    """Asks once more for the items that failed, then for all that arrived since the last run, and stops.

    items: a stream; its source's own limit (as maxFilesPerTrigger) makes the batches small. answer gives each item with
    model_output and error. An item (index and path) with a finished row in the sink is not asked again, whatever source
    file brings it anew; one whose answer was blank or an error is, once a run.

    seconds: when they are over, the open batch ends and is published, and no other begins; at least one does. The next
    run goes on from there, and any number of cut runs gives what a whole one gives.
    """
    spark, keys = items.sparkSession, keys or ["index", "video_path"]
    table, began, columns = VersionedTable(spark, sink), clock(), items.columns
    run, cut = Run(0, True), False

    def put(rows: DataFrame, writer: str | None, step: int) -> None:
        table.append(*table.put(answer(rows)), writer=writer, step=step)
        run.batches += 1

    def over() -> bool:
        return seconds is not None and run.batches > 0 and clock() - began >= seconds

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal cut
        if table.step_of(checkpoint) >= number:
            return  # published before a crash that came ahead of its mark in the checkpoint
        if over():
            cut = True
            raise _TimeIsUpError
        had = table.read()
        fresh = rows.dropDuplicates(keys)
        put(fresh if had is None else joins.to_do(fresh, had, keys), checkpoint, number)

    if table.current() is not None:
        failed = results(spark, sink, keys)
        failed = failed.join(joins.done_rows(failed).select(*keys), keys, "left_anti").select(*columns)
        if not failed.isEmpty():
            put(failed, None, 0)
    query = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not cut:
            raise
        run.finished = False
    return run


def results(spark: SparkSession, sink: str, keys: list[str] | None = None) -> DataFrame:
    """One row an item of a sink: its last finished row, or its last one where none is."""
    keys = keys or ["index", "video_path"]
    table = VersionedTable(spark, sink)
    now: Version | None = table.current()
    if now is None:
        raise FileNotFoundError(f"nothing was answered into {sink}")
    rows = table.read(now)
    values = [c for c in rows.columns if c not in keys]
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    error = filled("error") if "error" in rows.columns else F.lit(False)
    order = F.struct((filled("model_output") & ~error).alias("done"), table.age(now).alias("age"))
    return rows.withColumn("_order", order).groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("_order")).alias("_row")).select(*keys, "_row.*")


def running_scores(answers: DataFrame, name: str) -> StreamingQuery:
    """Counts of right answers by cell as they arrive, in a table of memory (a few cells)."""
    totals = answers.groupBy("sampler", "num_frames").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    return totals.writeStream.format("memory").queryName(name).outputMode("complete").start()


CACHE = "key string, pos long, item string, hit boolean, admitted boolean, evicted array<string>"


def cache_simulation(requests: DataFrame, capacity: int, policy: str = "keep") -> DataFrame:
    """What a cache of so many bytes would have done with each sequence of requests (key, pos, item, size).

    keep: an item that doesn't fit beside those kept is used and dropped, so a scan can't flush the cache; lru: the
    least recently used go until it fits; fifo: the first that came go, whether used since or not. An item larger than
    the cache is never admitted.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[str, int] = OrderedDict()
        out = []
        for r in rows.sort_values("pos").itertuples():
            hit, gone, admitted = r.item in held, [], False
            if hit:
                if policy != "fifo":
                    held.move_to_end(r.item)
            elif r.size <= capacity:
                while policy in ("lru", "fifo") and sum(held.values()) + r.size > capacity:
                    gone.append(held.popitem(last=False)[0])
                if admitted := sum(held.values()) + r.size <= capacity:
                    held[r.item] = r.size
            out.append((r.key, r.pos, r.item, hit, admitted, gone))
        return pd.DataFrame(out, columns=["key", "pos", "item", "hit", "admitted", "evicted"])

    return requests.groupBy("key").applyInPandas(run, CACHE)
