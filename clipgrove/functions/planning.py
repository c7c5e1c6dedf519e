"""Bitrates, sizes and share budgets as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
QUALITY_FACTORS = {"low": 0.06, "normal": 0.10, "high": 0.16, "veryhigh": 0.24, "ultra": 0.40}
MIN_BITRATE, MAX_BITRATE, MAX_PEAK = 1_000_000, 150_000_000, 300_000_000
AUDIO_BPS = 128_000
CONTAINER_BPS = 320_000
MIN_VIDEO_BPS = 300_000
USABLE_SHARE = 0.97
LADDER = (1080, 720, 480)
PRESETS_MB = (10, 50, 100)
VERTICAL_WIDTH = 1080


def _clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high)).cast("bigint")


def _big(c: Column) -> Column:
    return c.cast("bigint")


def _even_down(c: Column) -> Column:
    return c - c % 2


def _even_up(c: Column) -> Column:
    return c + c % 2


def quality_factor(quality: Column) -> Column:
    out = F.lit(QUALITY_FACTORS["high"])
    for name, factor in QUALITY_FACTORS.items():
        out = F.when(quality == name, F.lit(factor)).otherwise(out)
    return out


def effective_fps(fps: Column) -> Column:
    f = fps.cast("double")
    return F.when(f <= 60, f).otherwise(60.0 * F.sqrt(f / 60.0))


def target_bitrate(width: Column, height: Column, fps: Column, quality: Column) -> Column:
    bps = (_big(width) * _big(height)).cast("double") * effective_fps(fps) * quality_factor(quality)
    return _clamp(_big(bps), MIN_BITRATE, MAX_BITRATE)


def peak_bitrate(mean: Column) -> Column:
    return F.least(F.floor(_big(mean) * 7 / 4), F.lit(MAX_PEAK)).cast("bigint")


def estimated_mb(height: Column, fps: Column, quality: Column, seconds: Column) -> Column:
    """Decimal MB of a 16:9 clip with one audio track."""
    width = F.floor(height * 16 / 9 / 2 + 0.5) * 2
    video = F.least(F.greatest(width * height * effective_fps(fps) * quality_factor(quality), F.lit(float(MIN_BITRATE))), F.lit(float(MAX_BITRATE)))
    return (video + AUDIO_BPS) / 8 * seconds / 1_000_000


def estimated_label(mb: Column) -> Column:
    return (
        F.when(mb >= 10_000, F.concat(F.floor(mb / 1000 + 0.5).cast("string"), F.lit(" GB")))
        .when(mb >= 1000, F.format_string("%.1f GB", mb / 1000))
        .otherwise(F.concat(F.floor(mb + 0.5).cast("string"), F.lit(" MB")))
    )


def output_dims(width: Column, height: Column, target: Column) -> Column:
    """Struct(width, height): even, never larger than the source; target 0 = as captured."""
    w, h = _big(width), _big(height)
    native = (target == 0) | (target >= h) | (h == 0)
    out_h = F.greatest(_even_down(_big(target)), F.lit(2))
    out_w = F.greatest(_even_down(F.floor(w * out_h / F.greatest(h, F.lit(1)))), F.lit(2))
    return F.struct(
        F.when(native, w).otherwise(out_w).cast("bigint").alias("width"),
        F.when(native, h).otherwise(out_h).cast("bigint").alias("height"))


def vertical_size(max_short: Column) -> Column:
    w = _even_down(F.least(F.coalesce(_big(max_short), F.lit(VERTICAL_WIDTH)), F.lit(VERTICAL_WIDTH)))
    h = _even_down(F.floor(w * 16 / 9) + 1)
    return F.struct(w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))


def vertical_bitrate(src_bps: Column, src_w: Column, src_h: Column, out_w: Column, out_h: Column) -> Column:
    px = F.greatest(_big(src_w) * _big(src_h), F.lit(1))
    total = _big(src_bps) * _big(out_w) * _big(out_h)
    return _clamp((total - total % px) / px, 4_000_000, 40_000_000)


def measured_bitrate(size_bytes: Column, secs: Column) -> Column:
    total = _big(size_bytes.cast("double") * 8.0 / secs)
    return F.when(secs > 0.1, _clamp(F.greatest(total - CONTAINER_BPS, F.lit(0)), 500_000, 120_000_000))


def scaled_width(w: Column, h: Column, height: Column) -> Column:
    return _even_up(F.floor(_big(w) * height / F.greatest(_big(h), F.lit(1))).cast("bigint"))


def share_plan(target_bytes: Column, seconds: Column, w: Column, h: Column, fps: Column, src_bps: Column) -> Column:
    """Struct(bitrate, max_height): the bitrate that fits the size, then the first rung (the
    source, then the ladder below it) the bitrate can carry, else the lowest rung."""
    secs = F.greatest(seconds, F.lit(0.1))
    usable = target_bytes.cast("double") * 8.0 * USABLE_SHARE - AUDIO_BPS * secs
    fitting = _big(F.greatest(usable / secs, F.lit(float(MIN_VIDEO_BPS))))
    bitrate = F.least(fitting, F.greatest(_big(src_bps), F.lit(MIN_VIDEO_BPS))).cast("bigint")
    src_h = _big(h)
    rungs = F.concat(F.array(src_h), F.filter(F.array(*[F.lit(r).cast("bigint") for r in LADDER]), lambda r: r < src_h))
    carried = F.filter(rungs, lambda r: bitrate >= F.floor(scaled_width(w, h, r) * r * F.greatest(_big(fps), F.lit(1)) / 60))
    height = F.coalesce(F.try_element_at(carried, F.lit(1)), F.element_at(rungs, -1))
    return F.struct(bitrate.alias("bitrate"), F.when(height < src_h, height).alias("max_height"))


def shared_bytes(size_bytes: Column, kept_sec: Column, duration_sec: Column) -> Column:
    size = size_bytes.cast("double")
    return F.when(duration_sec <= 0, size).otherwise(size * F.least(F.lit(1.0), kept_sec / duration_sec))


def preset_disabled(shared: Column, preset_mb: Column) -> Column:
    return shared <= preset_mb * 1048576


def fingerprint(*cols: Column) -> Column:
    """Content key of everything that shapes a result; NULL and '' differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
