"""Column builders on 16-bit samples. Single precision where results must agree to the bit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
FULL_SCALE = 32768.0
KNEE = 0.75
CENTER_GAIN = 0.707
SILENCE_PEAK = 0.001
MIX_RATES = (44_100, 48_000)


def f32(c: Column | float) -> Column:
    return (F.lit(c) if isinstance(c, (int, float)) else c).cast("float")


def to_i16(c: Column) -> Column:
    """Clamped, fraction cut off."""
    return F.least(F.greatest(c, f32(-32768.0)), f32(32767.0)).cast("int")


def apply_gain(sample: Column, gain: Column) -> Column:
    return to_i16(f32(sample) * f32(gain))


def soft_clip(x: Column) -> Column:
    """Linear up to the knee, a soft curve above."""
    n = x / FULL_SCALE
    a = F.abs(n)
    curve = F.signum(n) * (KNEE + (1 - KNEE) * (1 - F.exp(-(a - KNEE) / (1 - KNEE))))
    return to_i16(f32(F.when(a <= KNEE, n).otherwise(curve)) * f32(32767.0))


def from_float(x: Column) -> Column:
    """[-1, 1] to 16 bits, rounded half away from zero."""
    return F.round(f32(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))) * f32(32767.0)).cast("int")


def downmix(channels: list[Column]) -> Column:
    """Struct(l, r): mono goes to both sides, centre and surrounds are added, LFE is left out."""
    if len(channels) == 1:
        return F.struct(f32(channels[0]).alias("l"), f32(channels[0]).alias("r"))
    sides = [f32(channels[0]), f32(channels[1])]
    if len(channels) > 2:
        centre = f32(CENTER_GAIN) * f32(channels[2])
        sides = [s + centre for s in sides]
    for i, c in enumerate(channels[4:]):
        sides[i % 2] = sides[i % 2] + f32(CENTER_GAIN) * f32(c)
    return F.struct(sides[0].alias("l"), sides[1].alias("r"))
