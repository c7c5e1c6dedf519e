"""Exact integer time conversions. ``hns`` = 100 ns units, ``ticks`` = a track's own scale.

Whole seconds are split off before multiplying, so that BIGINT never overflows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
SECOND = 10_000_000
MOVIE_SCALE = 1000
SAMPLE_RATE = 48_000


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division, towards zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def floor_div(a: Column, n: int) -> Column:
    return idiv(a - F.pmod(a, F.lit(n)), n)


def to_ticks(hns: Column, scale: int | Column) -> Column:
    t = F.greatest(hns, F.lit(0).cast("bigint"))
    s = F.lit(scale).cast("bigint") if isinstance(scale, int) else scale.cast("bigint")
    return idiv(t, SECOND) * s + idiv(t % SECOND * s + SECOND // 2, SECOND)


def to_hns(ticks: Column, scale: int | Column) -> Column:
    s = F.lit(scale).cast("bigint") if isinstance(scale, int) else scale.cast("bigint")
    return idiv(ticks, s) * SECOND + idiv(ticks % s * SECOND, s)


def to_movie(ticks: Column, scale: int) -> Column:
    """Ticks to ms, rounded."""
    return idiv(ticks, scale) * MOVIE_SCALE + idiv(ticks % scale * MOVIE_SCALE + scale // 2, scale)


def to_frame(time: Column, origin: Column, rate: int = SAMPLE_RATE) -> Column:
    """Sample frame at or before a time; floors for times before the origin too."""
    d = time - origin
    return floor_div(d, SECOND) * rate + idiv(F.pmod(d, F.lit(SECOND)) * rate, SECOND)


def cfr_pts(slot: Column, fps: int) -> Column:
    return F.lit(0).cast("bigint") if fps == 0 else idiv(slot * SECOND, fps)


def time_slot(time: Column, base: Column, interval: int) -> Column:
    d = time - base
    return F.when(d <= 0, F.lit(0).cast("bigint")).otherwise(idiv(d + interval // 2, max(interval, 1)))


def fps_interval(fps: int) -> int:
    return 0 if fps == 0 else SECOND // fps
