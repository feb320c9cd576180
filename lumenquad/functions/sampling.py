"""Index selection as array expressions: uniform, pooled, fixed-rate, top-k, order probes.

Even spacing is i * ((total - 1) / (n - 1)) with the last index pinned; rint rounds ties to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(n: Column) -> Column:
    """0 to n - 1, empty for n = 0 (sequence alone would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _spaced(total: Column, n: Column, whole) -> Column:
    step = (total - 1) / F.greatest(n - 1, F.lit(1))
    return F.transform(_first(n), lambda i: F.when((i == n - 1) & (n > 1), total - 1).otherwise(whole(i * step)).cast("int"))


def uniform(total: Column, n: Column) -> Column:
    """All indices of a short clip, else n evenly spaced ones."""
    total, n = total.cast("int"), n.cast("int")
    return F.when(total <= n, _first(total)).otherwise(_spaced(total, n, F.rint))


def uniform_clamped(total: Column, n: Column) -> Column:
    """Evenly spaced with 1 <= n <= total."""
    k = F.greatest(F.lit(1), F.least(n, total)).cast("int")
    return _spaced(total.cast("int"), k, F.rint)


def pool(total: Column, size: Column) -> Column:
    """Candidate pool: truncated spacing; short clips are padded with their last index."""
    total, size = total.cast("int"), size.cast("int")
    padded = F.concat(_first(total), F.array_repeat((total - 1).cast("int"), F.greatest(size - total, F.lit(0))))
    return F.when(total >= size, _spaced(total, size, F.floor)).otherwise(padded)


def frame_rate(fps: Column) -> Column:
    return F.when(fps > 1e-3, fps).otherwise(F.lit(30.0))


def one_per_second(total: Column, fps: Column, most: int = 512) -> Column:
    """An index a second, clamped and distinct; evenly spaced ones where there are more than `most`."""
    total, fps = total.cast("int"), F.greatest(fps.cast("double"), F.lit(1e-3))
    n = F.greatest(F.lit(1), F.floor(total / fps) + 1).cast("int")
    found = F.array_sort(F.array_distinct(F.transform(_first(n), lambda t: F.least(F.rint(t * fps).cast("int"), total - 1))))
    found = F.when(total > 0, found).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(found) > most, uniform(total, F.lit(most))).otherwise(found)


def at(values: Column, places: Column) -> Column:
    """Elements of an array at 0-based places."""
    return F.transform(places, lambda i: F.try_element_at(values, i.cast("int") + 1))


def of_pool(pool_indices: Column, k: Column) -> Column:
    """Evenly spaced part of a stored pool."""
    return at(pool_indices, uniform_clamped(F.size(pool_indices), k))


def top_k(pool_indices: Column, keep: Column, k: Column) -> Column:
    """Pool indices of the k highest probabilities (ties: first), in temporal order."""
    n = F.greatest(F.lit(1), F.least(k.cast("int"), F.size(keep)))
    ranked = F.array_sort(F.transform(keep, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return at(pool_indices, F.array_sort(F.transform(F.slice(ranked, F.lit(1), n), lambda r: r["i"])))


def replayed(selected: Column, pool_indices: Column, k: Column) -> Column:
    """First k of a recorded selection of pool places, in order, as indices."""
    return at(pool_indices, F.slice(F.array_sort(selected), F.lit(1), F.greatest(k.cast("int"), F.lit(0))))


def fixed_step(total: Column, video_fps: Column, fps: Column, most: Column) -> Column:
    """Every so many frames, at most `most`."""
    step = F.greatest(F.lit(1), F.rint(F.when(video_fps > 0, video_fps).otherwise(F.lit(24.0)) / fps).cast("int"))
    return F.when(total > 0, F.slice(F.sequence(F.lit(0), F.greatest(total, F.lit(1)).cast("int") - 1, step), F.lit(1), most.cast("int"))).otherwise(F.array().cast("array<int>"))


def by_strategy(strategy: Column, total: Column, n: Column, drawn: Column, kept: Column) -> Column:
    """Dispatch: uniform is computed; a seeded draw and a learned selection come in."""
    return F.when(strategy == "uniform", uniform(total, n)).when(strategy == "random", drawn).when(strategy == "hornet", kept).otherwise(F.raise_error(F.lit("unknown strategy")).cast("array<int>"))


def or_uniform(kept: Column, spread: Column, total: Column, n: Column, least: float) -> Column:
    """A learned selection unless its probabilities are not finite or hardly spread."""
    flat = spread.isNull() | F.isnan(spread) | (F.abs(spread) == float("inf")) | (spread < least)
    return F.when(flat, uniform(total, n)).otherwise(kept)


def window_of(center: Column, length: Column, n: Column) -> Column:
    """struct(lo, hi): `length` places around a centre, moved inside 0 .. n - 1."""
    half = F.floor((length - 1) / 2).cast("int")
    lo, hi = F.greatest(F.lit(0), center - half), F.least(n - 1, center + (length - 1 - half))
    lo2 = F.greatest(F.lit(0), F.least(lo, hi - length + 1))
    return F.struct(lo2.cast("int").alias("lo"), F.least(n - 1, F.greatest(hi, lo2 + length - 1)).cast("int").alias("hi"))


def crops(scale: Column, base: int = 8) -> Column:
    """Crops that a resolution scale leaves of a base number."""
    s = F.greatest(scale.cast("double"), F.lit(1.0))
    return F.greatest(F.lit(1), F.rint(base / (s * s)).cast("int"))
