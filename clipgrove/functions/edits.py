"""Column builders over one edit: mixer, look, no-op and identity tests, export decision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
F32_EPSILON = 1.1920929e-07
LOOK_EPSILON = 1e-4
GAIN_TOLERANCE = 1e-3
BOUND_TOLERANCE_MS = 1.0
IDENTITY_TOLERANCE_MS = 50.0
SILENCE = 0.001
LOOK_FIELDS = ("brightness", "contrast", "saturation", "temperature", "sharpness")


def track_gain(mixer: Column, track: str | Column) -> Column:
    """``mixer``: MAP<id, STRUCT<vol, muted>>. Missing 1, muted 0, else the volume, never negative."""
    key = F.lit(track) if isinstance(track, str) else track
    t = F.try_element_at(mixer, key)
    return F.when(t.isNull(), 1.0).when(t["muted"], 0.0).otherwise(F.greatest(t["vol"], F.lit(0.0)))


def mixer_untouched(mixer: Column) -> Column:
    return F.coalesce(
        F.forall(F.map_values(mixer), lambda t: ~t["muted"] & (F.abs(t["vol"] - 1.0) <= F32_EPSILON)), F.lit(True)
    )


def legacy_mixer(tracks: Column, sys_vol: Column, sys_muted: Column, mic_vol: Column, mic_muted: Column) -> Column:
    """Old scalar volumes become the tracks sys and mic unless those are present."""
    tracks = F.coalesce(tracks, F.expr("cast(map() AS map<string, struct<vol: double, muted: boolean>>)"))

    def scalar(name, vol, muted):
        value = F.struct(F.coalesce(vol, F.lit(1.0)).alias("vol"), F.coalesce(muted, F.lit(False)).alias("muted"))
        usable = (vol.isNotNull() | muted.isNotNull()) & ~F.map_contains_key(tracks, name)
        return F.when(usable, F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))).otherwise(
            F.expr("cast(array() AS array<struct<key: string, value: struct<vol: double, muted: boolean>>>)"))

    extra = F.concat(scalar("sys", sys_vol, sys_muted), scalar("mic", mic_vol, mic_muted))
    return F.map_concat(tracks, F.map_from_entries(extra))


def look_neutral(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & (F.abs(F.coalesce(v, F.lit(0.0))) < LOOK_EPSILON)
    return out


def untrimmed(start: Column, end: Column, bound_start: Column, bound_end: Column, disabled: Column) -> Column:
    """An enabled segment equal to its bounds; unknown bounds count as trimmed."""
    near = (F.abs(start - bound_start) < BOUND_TOLERANCE_MS) & (F.abs(end - bound_end) < BOUND_TOLERANCE_MS)
    return ~F.coalesce(disabled, F.lit(False)) & F.coalesce(near, F.lit(False))


def is_noop(format_kind: Column, look: list[Column], mixer: Column, segments: Column) -> Column:
    """Nested form: ``segments`` ARRAY<STRUCT<start_ms, end_ms, bound_start_ms, bound_end_ms, disabled, ...>>."""
    first = F.try_element_at(segments, F.lit(1))
    only = untrimmed(first["start_ms"], first["end_ms"], first["bound_start_ms"], first["bound_end_ms"], first["disabled"])
    n = F.coalesce(F.size(segments), F.lit(0))
    plain = F.coalesce(format_kind, F.lit("horizontal")) == "horizontal"
    return plain & look_neutral(*look) & mixer_untouched(mixer) & ((n <= 0) | ((n == 1) & only))


def is_identity(format_kind: Column, mixer: Column, n: Column, start: Column, end: Column, disabled: Column, duration_sec: Column) -> Column:
    """One enabled segment over the whole clip; ``start``/``end``/``disabled`` of that segment."""
    tol = F.lit(IDENTITY_TOLERANCE_MS)
    whole = (start <= tol) & (end >= duration_sec * 1000.0 - tol)
    return F.coalesce((format_kind == "horizontal") & (n == 1) & ~disabled & mixer_untouched(mixer) & whole, F.lit(False))


def shares_original(ext: Column, identity: Column) -> Column:
    return (F.lower(ext) == "mp4") & identity


# Order of the reasons is fixed.
REASONS = ("not_h264", "watermark", "vertical", "look", "target_bitrate", "rescaled", "out_of_order")


def export_decision(h264, watermark, vertical, graded, target_bitrate, rescaled, in_order, on_keyframes) -> Column:
    """Struct(copy, reasons): packets may be copied when nothing asks for new frames."""
    flags = [~h264, watermark, vertical, graded, target_bitrate, rescaled, ~in_order]
    why = F.filter(F.array(*[F.when(f, F.lit(r)) for f, r in zip(flags, REASONS)]), lambda r: r.isNotNull())
    copy = (F.size(why) == 0) & on_keyframes
    text = F.when(F.size(why) > 0, F.array_join(why, ", ")).when(~on_keyframes, F.lit("off_keyframe")).otherwise(F.lit(""))
    return F.struct(copy.alias("copy"), text.alias("reasons"))


def audio_plan(gains: Column, has_mix: Column) -> Column:
    """none / copy / gain / remix from ARRAY<DOUBLE> of the track gains and the mix track."""
    def at_one(g):
        return F.abs(g - 1.0) < GAIN_TOLERANCE

    n = F.size(gains)
    only = F.try_element_at(gains, F.lit(1))
    return (
        F.when(has_mix & (F.forall(gains, at_one) | (n == 0)), "copy")
        .when(n >= 2, "remix").when(n == 0, "none").when(at_one(only), "copy").otherwise("gain")
    )
