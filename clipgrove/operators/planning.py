"""Share plans for whole libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clipgrove.functions import planning as N


def plan_all(clips: DataFrame, presets_mb: tuple[int, ...] = N.PRESETS_MB) -> DataFrame:
    """clips(..., size_bytes, duration_sec, kept_sec, width, height, fps): every clip with every
    preset. The presets are a short literal list, so this is an explode and needs no join."""
    c = F.col
    rows = clips.withColumn("preset_mb", F.explode(F.array(*[F.lit(p).cast("bigint") for p in presets_mb])))
    source = F.coalesce(N.measured_bitrate(c("size_bytes"), c("duration_sec")), F.lit(N.MIN_VIDEO_BPS))
    secs = F.when(c("kept_sec") > 0, c("kept_sec")).otherwise(c("duration_sec"))
    rows = rows.withColumn("_plan", N.share_plan(c("preset_mb") * 1048576, secs, c("width"), c("height"), c("fps"), source))
    shared = N.shared_bytes(c("size_bytes"), secs, c("duration_sec"))
    return rows.select(
        *clips.columns, "preset_mb", c("_plan.bitrate").alias("bitrate"), c("_plan.max_height").alias("max_height"),
        shared.alias("shared_bytes"), N.preset_disabled(shared, c("preset_mb")).alias("disabled"))
