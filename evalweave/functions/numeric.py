"""Time windows, sampling positions, seeds and ratios as column expressions.

Two things need Python's own arithmetic, which no built-in repeats: rounding to decimals by exact binary value, and
``.3f``. They are Arrow UDFs over plain doubles.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a window, of an audio snippet, their number, native padding; tokens that end an output.
WINDOW_SECONDS, SNIPPET_SECONDS, SNIPPETS, PADDED_SECONDS, TOKEN_LIMIT = 12.0, 2.0, 8, 30, 256
#: Frames are sampled at twice a second, at least 4, at most 32; pixel areas are between these.
FRAMES_PER_SECOND, LEAST_FRAMES, MOST_FRAMES = 2, 4, 32
PATCH, LEAST_PATCHES, MOST_PATCHES = 28, 128, 768


def round_decimals(value: Column, digits: int) -> Column:
    """Rounds as decimal arithmetic on the exact binary value does, half to even."""
    step = Decimal(1).scaleb(-digits)

    @F.pandas_udf(T.DoubleType())
    def rounded(values: pd.Series) -> pd.Series:
        def one(x: float) -> float:
            return float(Decimal(x).quantize(step, rounding=ROUND_HALF_EVEN)) if abs(x) < 1e15 else x

        return values.map(one, na_action="ignore")

    return rounded(value.cast("double"))


@F.pandas_udf(T.StringType())
def fixed3(values: pd.Series) -> pd.Series:
    """Three decimals of the exact binary value."""
    return values.map(lambda x: f"{x:.3f}", na_action="ignore")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def window_bounds(center: Column, duration: Column) -> tuple[Column, Column]:
    """Start and end, not rounded, of a window around center that stays inside the clip."""
    width = F.least(F.lit(WINDOW_SECONDS), duration)
    start = F.least(F.greatest(center - width / 2, F.lit(0.0)), duration - width)
    return start, start + width


def window_interval(center: Column, duration: Column) -> Column:
    """struct<start,end>, rounded to milliseconds; a duration that is not finite and positive is an error."""
    start, end = window_bounds(center, duration)
    checked = F.when(is_finite(duration) & (duration > 0), start).otherwise(F.raise_error(F.lit("duration must be finite and positive")).cast("double"))
    return F.struct(round_decimals(checked, 3).alias("start"), round_decimals(end, 3).alias("end"))


def fixed_center(duration: Column, look: int) -> Column:
    """The uniform centres: a third and two thirds of the clip (look 0 and 1)."""
    return duration * (look + 1) / 3


def half_up(n: Column, share: float) -> Column:
    return F.floor(n.cast("double") * F.lit(share) + F.lit(0.5))


def salted_hash(*parts: Column | str) -> Column:
    """SHA-256 in hexadecimal of the parts, joined by vertical bars."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def hash_parity(key: Column) -> Column:
    """The lowest bit of SHA-256."""
    return F.conv(F.right(F.sha2(key.cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 2


def arm_order(key: Column) -> Column:
    """Which arm runs first: decided by the question's hash."""
    return F.when(hash_parity(key) == 1, F.array(F.lit("agent"), F.lit("fixed"))).otherwise(F.array(F.lit("fixed"), F.lit("agent")))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in doubles; null for an empty whole."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def percent_required(part: Column, whole: Column) -> Column:
    """The same where an empty whole is an error."""
    return F.lit(100.0) * part / whole.cast("double")


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < F.lit(tolerance)


def linspace(first: Column, last: Column, n: Column) -> Column:
    """n evenly spaced doubles with both ends (n >= 1)."""
    step = F.when(n > 1, (last - first) / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: first + i * step)


def frame_count(duration: Column, total: Column) -> Column:
    """An even number of frames: two for each second, within limits and the clip's own."""
    wanted = F.greatest(duration * FRAMES_PER_SECOND, F.lit(float(LEAST_FRAMES)))
    return (F.floor(F.floor(F.least(wanted, F.lit(float(MOST_FRAMES)), total.cast("double"))) / 2) * 2).cast("int")


def frame_indices(count: Column, total: Column) -> Column:
    """Evenly spaced frame numbers, halves to the even one."""
    return F.transform(linspace(F.lit(0.0), total.cast("double") - 1, count), lambda x: F.rint(x).cast("bigint"))


def effective_fps(count: Column, times: Column) -> Column:
    """Frames a second between the first and the last sampled time; an error unless positive."""
    rate = F.try_divide((count - 1).cast("double"), F.element_at(times, -1) - F.get(times, F.lit(0)))
    return F.when(rate > 0, rate).otherwise(F.raise_error(F.lit("invalid video times")).cast("double"))


def snippet_starts(seconds: Column) -> Column:
    """Starts of the evenly spaced audio snippets."""
    return linspace(F.lit(0.0), F.greatest(F.lit(0.0), seconds - SNIPPET_SECONDS), F.lit(SNIPPETS))


def snippet_seconds(seconds: Column) -> Column:
    """Seconds of audio in all snippets together."""
    return F.aggregate(snippet_starts(seconds), F.lit(0.0), lambda s, x: s + F.least(F.lit(SNIPPET_SECONDS), seconds - x))


def resize_plan(height: Column, width: Column) -> Column:
    """struct<height,width>: multiples of the patch size with an area between the limits."""
    patch, low, high = float(PATCH), float(LEAST_PATCHES * PATCH**2), float(MOST_PATCHES * PATCH**2)
    h, w = height.cast("double"), width.cast("double")
    near = [F.greatest(F.lit(patch), F.rint(x / patch) * patch) for x in (h, w)]
    shrink, grow = F.sqrt(h * w / high), F.sqrt(F.lit(low) / (h * w))
    less = [F.greatest(F.lit(patch), F.floor(x / shrink / patch) * patch) for x in (h, w)]
    more = [F.ceil(x * grow / patch) * patch for x in (h, w)]
    area = near[0] * near[1]
    pick = [F.when(area > high, lo).when(area < low, hi).otherwise(mid) for mid, lo, hi in zip(near, less, more, strict=True)]
    return F.struct(pick[0].cast("int").alias("height"), pick[1].cast("int").alias("width"))


def epoch_seconds() -> Column:
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6)


def hit_token_limit(tokens: Column) -> Column:
    return tokens >= TOKEN_LIMIT


def option_of_letter(options: Column, letter: Column) -> Column:
    """The option that a letter names, A being the first."""
    return F.get(options, F.ascii(F.upper(F.trim(letter))) - F.lit(65))
