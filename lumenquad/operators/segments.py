"""Segmentation of relevance series and merging of intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sampling
from ..sources import staging
from .scans import Scan


def _marked(series: DataFrame, key: str, pos: str, score: str, parts: int | None) -> tuple[Scan, DataFrame]:
    """Rows of a series in range parts, with whether they are a valley and whether they are its ends."""
    scan = Scan(series, [key], [pos], parts)
    rows = scan.with_neighbours(score, "_b", "_a")
    end = F.col("_b").isNull() | F.col("_a").isNull()
    return scan, rows.withColumn("_v", end | ((F.col(score) <= F.col("_b")) & (F.col(score) <= F.col("_a"))))


def valleys(series: DataFrame, key: str = "key", pos: str = "pos", score: str = "score", parts: int | None = None) -> DataFrame:
    """Places no higher than both neighbours, and both ends."""
    scan, rows = _marked(series, key, pos, score, parts)
    return scan.done(rows.where("_v"), "_b", "_a", "_v")


def basin_peaks(series: DataFrame, key: str = "key", pos: str = "pos", score: str = "score", parts: int | None = None) -> DataFrame:
    """Highest place (ties: first) of each basin between valleys; a valley belongs to both of its basins."""
    scan, rows = _marked(series, key, pos, score, parts)
    # Basin number: valleys up to here. A valley that isn't the first closes the basin before it as well.
    marked = scan.running_sum(rows, F.col("_v").cast("long"), "_k")
    both = F.when(F.col("_v") & F.col("_a").isNull() & (F.col("_k") > 1), F.array(F.col("_k") - 1)).when(F.col("_v") & (F.col("_k") > 1), F.array(F.col("_k") - 1, F.col("_k"))).otherwise(F.array("_k"))
    peaks = marked.select(key, pos, score, F.explode(both).alias("_k")).groupBy(key, "_k").agg(F.max_by(pos, F.struct(F.col(score), -F.col(pos))).alias(pos))
    return peaks.select(key, pos).distinct()


def merged(clips: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", members: str | None = None, value: str | None = None, parts: int | None = None) -> DataFrame:
    """Overlapping or touching intervals of a group become one: its bounds, their number, the least `value` and the
    union of the `members` arrays.

    Null bounds come last: a row without `lo` joins the group's last interval, and a null `hi` reaches nowhere. Rows of
    equal bounds have one order for all steps, so ties don't change the result.
    """
    clips = clips.withColumns({"_no_lo": F.col(lo).isNull(), "_no_hi": F.col(hi).isNull()})
    scan = Scan(clips, by, ["_no_lo", lo, "_no_hi", hi], parts)
    states = scan.states(scan.rows, _top=F.max(hi))
    rows = scan.carried(scan.rows, states, _carry=F.max("_top").over(scan.parts_before))
    reach = F.greatest(F.max(hi).over(scan.local.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    new = F.coalesce(reach.isNull() | (F.col(lo) > reach), F.lit(False))
    island = scan.running_sum(rows.withColumn("_new", new.cast("long")), F.col("_new"), "_island")
    more = [F.min(value).alias(value)] if value else []
    more += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(members)))).alias(members)] if members else []
    return island.groupBy(*by, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n_merged"), *more).drop("_island")


def frame_plan(clips: DataFrame, key: str = "key", members: str = "idxs", scale: str = "s") -> DataFrame:
    """Frames of all clips once, with the least scale."""
    return clips.select(key, F.explode(members).alias("frame"), scale).groupBy(key, "frame").agg(F.min(scale).alias(scale))


def kmeans_1d(positions: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each position: means from even quantiles, at most 25 rounds; an empty cluster takes a random place."""
    x = positions.astype(float)
    k = max(1, min(k, len(x)))
    means = np.quantile(x, np.linspace(0, 1, k))
    own = np.zeros(len(x), int)
    for _ in range(25 if k > 1 else 0):
        own = np.abs(x[:, None] - means).argmin(1)
        fresh = np.array([x[own == c].mean() if (own == c).any() else x[int(rng.integers(0, len(x)))] for c in range(k)])
        done = np.allclose(fresh, means)
        if done:
            break
        means = fresh
    return own


#: Where the two clusters start.
LOBE_SEEDS = [(0.15, 0.75), (0.55, 0.45)]


def two_lobes(points: np.ndarray, aspect: float = 0.41, rounds: int = 60, least_share: float = 0.15, least_gap: float = 0.18) -> np.ndarray | None:
    """Two clusters of points (y weighs less), or None if they are few, uneven or close."""
    if len(points) < 20:
        return None
    x = points * [1.0, aspect]
    means = np.array(LOBE_SEEDS) * [1.0, aspect]
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        far = ((x[:, None] - means) ** 2).sum(2)
        own = (far[:, 0] >= far[:, 1]).astype(int)
        fresh = np.array([x[own == c].mean(0) if (own == c).any() else means[c] for c in range(2)])
        if np.array_equal(fresh, means):
            break
        means = fresh
    share = np.bincount(own, minlength=2).min() / len(x)
    return None if share < least_share or np.linalg.norm(means[0] - means[1]) < least_gap else own


def lobes(points: DataFrame, by: str, x: str = "x", y: str = "y", aspect: float = 0.41, rounds: int = 60, least_share: float = 0.15, least_gap: float = 0.18) -> DataFrame:
    """points with `lobe` 0 or 1: the two clusters of each key's points (y weighs less), as two_lobes() finds them for one
    key; null where they are few, uneven or close, for a null key and for points without both places.

    A round is one aggregate over all points and leaves four means a key, written so that no round's plan holds the one
    before; rounds end when no mean moves. A key's points are never one task's: their sums combine before the shuffle.
    """
    spark = points.sparkSession
    rows = points.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double") * aspect})
    placed = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).select(by, "_x", "_y")
    seeds = dict(zip(("_ax", "_ay", "_bx", "_by"), (v * w for m in LOBE_SEEDS for v, w in zip(m, (1.0, aspect), strict=True)), strict=True))
    means = placed.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= 20).withColumns({c: F.lit(v) for c, v in seeds.items()})
    far = lambda a, b: (F.col("_x") - F.col(a)) * (F.col("_x") - F.col(a)) + (F.col("_y") - F.col(b)) * (F.col("_y") - F.col(b))
    second = far("_ax", "_ay") >= far("_bx", "_by")
    for _ in range(rounds):
        sums = [F.avg(F.when(second if c[1] == "b" else ~second, F.col(f"_{c[2]}"))).alias(f"{c}2") for c in seeds]
        fresh = placed.join(means, by).groupBy(by, "_n", *seeds).agg(*sums, F.count_if(second).alias("_second"))
        moved = F.greatest(*(F.abs(F.coalesce(f"{c}2", c) - F.col(c)) for c in seeds))
        fresh = fresh.select(by, "_n", "_second", moved.alias("_moved"), *(F.coalesce(f"{c}2", c).alias(c) for c in seeds))
        found = staging.written(fresh, staging.new_path(spark, "lobes"))
        means = found.drop("_moved", "_second")
        if found.where("_moved > 1e-12").isEmpty():
            break
    share = F.least(F.col("_second"), F.col("_n") - F.col("_second")) / F.col("_n")
    gap = F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by"))
    apart = found.where((share >= least_share) & (gap >= least_gap)).select(by, *seeds)
    return rows.join(apart, by, "left").withColumn("lobe", F.when(F.col("_ax").isNotNull() & F.col("_x").isNotNull(), second.cast("int"))).drop("_x", "_y", *seeds)


def clustered(scores: np.ndarray, positions: np.ndarray, k: int, seed: int = 0) -> list[int]:
    """Places of k of these peaks, in order: the best of each cluster in time, and the next best where clusters are fewer."""
    own = kmeans_1d(positions, k, np.random.default_rng(seed))
    by_score = sorted(range(len(scores)), key=lambda i: -scores[i])
    chosen = list({own[i]: i for i in reversed(by_score)}.values())
    chosen += [i for i in by_score if i not in chosen][: k - len(chosen)]
    return sorted(chosen)[:k]


def clip_lengths(anchors: DataFrame, series: DataFrame, redundancy: float = 0.5, length: float = 0.05) -> DataFrame:
    """anchors (key, pos, n, most) with `length`: that of the best window around each, 1 to `most` rows of its series.

    Best is mean score, less mean similarity of the window's pairs, plus a bonus for length; ties: the shortest. An anchor
    meets only the rows that its windows may hold, at most 2 * most - 1, so a series of any length is no single task. The
    pairs' mean comes from the sum of the vectors. Null scores and vectors are left out of the means.
    """
    first = F.greatest(F.lit(0), F.col("pos") - F.col("most") + 1)
    last = F.least(F.col("n") - 1, F.col("pos") + F.col("most") - 1)
    near = anchors.select("key", F.col("pos").alias("_c"), F.explode(F.sequence(first, last)).alias("pos")).join(series.select("key", "pos", "score", "embedding"), ["key", "pos"])
    near = near.groupBy("key", F.col("_c").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "score", "embedding"))).alias("_near"))

    def dot(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double") * e)

    def value(size: Column) -> Column:
        w = sampling.window_of(F.col("pos").cast("int"), size, F.col("n").cast("int"))
        rows = F.filter("_near", lambda r: (r["pos"] >= w["lo"]) & (r["pos"] <= w["hi"]))
        scores = F.filter(F.transform(rows, lambda r: r["score"].cast("double")), lambda x: x.isNotNull())
        vectors = F.filter(F.transform(rows, lambda r: r["embedding"].cast("array<double>")), lambda x: x.isNotNull())
        total = F.aggregate(vectors, F.array().cast("array<double>"), lambda t, v: F.zip_with(t, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
        m = F.size(vectors)
        own = F.aggregate(vectors, F.lit(0.0), lambda s, v: s + dot(v))
        alike = F.when(m > 1, (dot(total) - own) / (m * (m - 1))).otherwise(0.0)
        mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(scores), F.lit(1))
        return F.struct((mean - redundancy * alike + length * size / F.col("most")).alias("value"), (-size).alias("size"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("most")), value))
    return anchors.join(near, ["key", "pos"]).withColumn("length", -best["size"]).drop("_near")


def thinned(peaks: DataFrame, budget: int, anchor_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """peaks (key, pos, score, video_index, n) of each series thinned to its share of the budget, with their `count`.

    Series within it keep all their peaks, without Python. Of others only the peaks meet in a group, to be clustered by
    time (anchors_of).
    """
    k = F.least(F.lit(max(1, round(anchor_ratio * budget))), F.col("n"))
    # A series' number of peaks by an aggregate, which combines before its shuffle, not by a window over the rows.
    sized = peaks.join(peaks.groupBy("key").agg(F.count("*").alias("_peaks")), "key").withColumn("_k", k)

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return rows.iloc[clustered(rows.score.to_numpy(float), rows.video_index.to_numpy(int), int(rows["_k"].iloc[0]), seed)]

    many = sized.where(F.col("_peaks") > F.col("_k")).groupBy("key").applyInPandas(thin, sized.schema)
    kept = sized.where(F.col("_peaks") <= F.col("_k")).unionByName(many)
    return kept.withColumn("count", F.least("_peaks", F.col("_k"))).drop("_peaks", "_k")


def scaled_clips(anchors: DataFrame, budget: int, s_max: float = 2.0) -> DataFrame:
    """anchors (pos, n, count, length) with the window lo, hi of their length, its scale s and the scale's group s_key."""
    s = F.least(F.lit(float(s_max)), F.greatest(F.lit(1.0), F.sqrt(F.col("count") * F.col("length") / max(budget, 1))))
    w = sampling.window_of(F.col("pos").cast("int"), F.col("length"), F.col("n").cast("int"))
    return anchors.withColumn("lo", w["lo"]).withColumn("hi", w["hi"]).withColumn("s", s).withColumn("s_key", F.bround("s", 3))


def segment(series: DataFrame, budget: int, anchor_ratio: float = 1.0, s_max: float = 2.0, redundancy: float = 0.5, length: float = 0.05, seed: int = 0) -> DataFrame:
    """Frames and scales for each series: anchors, best clip lengths, merged clips of one resolution, least scale.

    series: key, pos (0, 1, 2, ...), score, video_index (ascending with pos), embedding. Peaks and merging run over range
    parts, lengths by anchor, so a series may be of any length; see thinned() for the one step by series. A row is
    listed once; an empty table gives no rows.
    """
    n = series.groupBy("key").agg(F.count("*").alias("n"))
    peaks = basin_peaks(series.select("key", "pos", "score")).join(series.select("key", "pos", "score", "video_index"), ["key", "pos"]).join(n, "key")
    most = F.greatest(F.lit(1), F.rint(F.lit(s_max**2 * budget) / F.col("count"))).cast("int")
    anchors = clip_lengths(thinned(peaks, budget, anchor_ratio, seed).withColumn("most", most), series, redundancy, length)
    clips = merged(scaled_clips(anchors, budget, s_max).select("key", "s_key", "lo", "hi", "s"), ["key", "s_key"], value="s")
    plan = frame_plan(clips.withColumn("idxs", F.sequence("lo", "hi"))).withColumnRenamed("frame", "pos")
    return plan.join(series.select("key", "pos", "video_index"), ["key", "pos"]).select("key", F.col("video_index").alias("frame"), F.col("s").alias("scale"))


def clip_windows(anchors: DataFrame, n: str = "n", center: str = "pos", length: str = "length") -> DataFrame:
    """anchors with lo and hi of the window of their length."""
    w = sampling.window_of(F.col(center), F.col(length), F.col(n))
    return anchors.withColumn("lo", w["lo"]).withColumn("hi", w["hi"])
