"""Cost accounting: image sizes, patch tokens, waiting times, axis steps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PATCH = 32
#: Fixed value: what a size over the cap on patches shrinks by, again and again.
STEP = 0.98
#: Greatest width, height and patches (0: no limit) at each level of detail; tokens a patch by model.
DETAIL = {"low": (512, 512, 0), "high": (2048, 2048, 2500), "original": (65535, 65535, 0), "auto": (65535, 65535, 0)}
MULTIPLIERS = {"gpt-5.6": 1.2, "gpt-5.5": 1.2, "gpt-5.4": 1.2}
DEFAULT_MULTIPLIER = 1.2


def multiplier(model: Column) -> Column:
    out = F.lit(DEFAULT_MULTIPLIER)
    for prefix, value in reversed(MULTIPLIERS.items()):
        out = F.when(F.startswith(model, F.lit(prefix)), F.lit(value)).otherwise(out)
    return out


def shrunk(width: Column, height: Column, most_w: Column | int, most_h: Column | int) -> Column:
    """struct(w, h): scaled down into a box, never up."""
    most_w, most_h = (x if isinstance(x, Column) else F.lit(x) for x in (most_w, most_h))
    s = F.least(most_w / width, most_h / height)
    fits = (width <= most_w) & (height <= most_h)
    side = lambda x: F.when(fits, x).otherwise(F.greatest(F.lit(1), F.floor(x * s))).cast("int")
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def longest_side(width: Column, height: Column, most: int) -> Column:
    """struct(w, h) with the longer side at most `most` (0: as it is)."""
    s = F.lit(float(most)) / F.greatest(width, height)
    over = F.greatest(width, height) > most if most else F.lit(False)
    side = lambda x: F.when(over, F.greatest(F.lit(1), F.floor(x * s))).otherwise(x).cast("int")
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def _patches(w: Column, h: Column) -> Column:
    return F.ceil(w / PATCH) * F.ceil(h / PATCH)


def _capped(width: Column, height: Column, cap: int, longest: int) -> Column:
    """Patches of sizes over the cap: scaled by the root of the excess, then by 2 % steps until they fit.

    A fold over as many steps as a side of `longest` can take until it is one patch, so no size runs out of them; steps
    behind the one that fits do nothing.
    """
    steps = max(0, math.ceil(math.log(max(1.0, longest / PATCH)) / -math.log(STEP))) + 1
    size = lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    scaled = lambda side, s: F.greatest(F.lit(1), F.floor(side * s))
    fits = lambda z: (_patches(z["w"], z["h"]) <= cap) | ((z["w"] <= PATCH) & (z["h"] <= PATCH))
    root = F.sqrt(F.lit(float(cap)) / _patches(width, height))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), size(scaled(width, root), scaled(height, root)), lambda z, _: F.when(fits(z), z).otherwise(size(scaled(z["w"], F.lit(STEP)), scaled(z["h"], F.lit(STEP)))))
    return F.transform(F.array(last), lambda z: _patches(z["w"], z["h"]))[0]


def image_tokens(width: Column, height: Column, detail: str = "low", model: Column | str = "gpt-5.6") -> Column:
    """Tokens of an image; 0 for an empty one."""
    most_w, most_h, cap = DETAIL[detail]
    model = model if isinstance(model, Column) else F.lit(model)
    size = shrunk(F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1)), most_w, most_h)
    patches = _patches(size["w"], size["h"])
    if cap:
        # Sizes that fit go through as they are.
        patches = F.when(patches <= cap, patches).otherwise(_capped(size["w"], size["h"], cap, max(most_w, most_h)))
    return F.when((width <= 0) | (height <= 0), F.lit(0)).otherwise(F.ceil(patches * multiplier(model))).cast("long")


def request_tokens(sizes: Column, text_tokens: int = 40, detail: str = "low", model: str = "gpt-5.6") -> Column:
    """Prompt and all its images; sizes: array of [w, h]."""
    each = F.transform(sizes, lambda s: image_tokens(s[0], s[1], detail, model))
    return F.lit(text_tokens) + F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def scaled_size(width: Column, height: Column, scale: Column) -> Column:
    """struct(w, h) at the inverse of a scale above 1."""
    side = lambda x: F.when(scale > 1 + 1e-6, F.greatest(F.lit(1), F.rint(x / scale))).otherwise(x).cast("int")
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(60.0), 1.5 * F.pow(F.lit(2.0), attempt))


def ticks(top: Column) -> Column:
    """Axis marks: the least of a few steps that needs at most eight."""
    out = F.array(F.lit(0), top.cast("int"))
    for step in (50, 25, 20, 10, 5):
        out = F.when(top / step <= 8, F.sequence(F.lit(0), F.floor(top / step).cast("int") * step, F.lit(step))).otherwise(out)
    return out
