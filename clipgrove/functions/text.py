"""Column builders for names, labels, paths and display texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values.
SCREEN_WORDS = r"(?i)^\s*(?:pantalla|screen)\b"
SCREEN_PART = r"(?i)^(?:pantalla|screen)\s+([0-9]+)$"
LABEL_SEPARATOR = " · "
BAD_NAME_CHARS = r'[/\\:*?"<>|]'
DEFAULT_STEM = "Clip"
DEFAULT_EXT = "mp4"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def effective_label(chosen: Column, detected: Column) -> Column:
    return F.coalesce(chosen, detected)


def override_of(chosen: Column, detected: Column) -> Column:
    name = strip(chosen)
    return F.when((name != "") & (F.lower(name) != F.lower(strip(detected))), name)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def file_ext(path: Column) -> Column:
    """Extension in lower case, '' if there is none (a leading dot is part of the name)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(stem != "", stem).when(name != "", name).otherwise(F.lit(DEFAULT_STEM))


def exe_basename(name: Column) -> Column:
    return F.lower(strip(F.regexp_extract(F.regexp_replace(name, "^>+", ""), r"([^/\\]*)$", 1)))


def is_screen(label: Column) -> Column:
    return label.rlike(SCREEN_WORDS)


def localize_label(label: Column, word: str) -> Column:
    def part(p: Column) -> Column:
        number = F.regexp_extract(strip(p), SCREEN_PART, 1)
        return F.when(number != "", F.concat(F.lit(word + " "), number)).otherwise(p)

    return F.array_join(F.transform(F.split(label, LABEL_SEPARATOR), part), LABEL_SEPARATOR)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", "-"), "^-+|-+$", "")


def initial(name: Column) -> Column:
    hit = F.regexp_extract(name, r"[\p{L}\p{N}]", 0)
    return F.when(hit != "", F.upper(hit)).otherwise(F.lit("?"))


def badge_kind(source: Column, cover: Column, icon: Column) -> Column:
    return (
        F.when(F.coalesce(cover, F.lit("")) != "", "cover")
        .when(strip(source) == "", "imported")
        .when(is_screen(source), "screen")
        .when(F.coalesce(icon, F.lit("")) != "", "game")
        .otherwise("initial")
    )


def _whole(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def format_duration(sec: Column) -> Column:
    return F.format_string("%02d:%02d", _whole(sec / 60), _whole(sec % 60))


def format_duration_ms(ms: Column) -> Column:
    whole = ms.cast("bigint")
    sec = _whole(whole / 1000)
    return F.format_string("%02d:%02d.%03d", _whole(sec / 60), sec % 60, whole % 1000)


def format_timecode(ms: Column) -> Column:
    sec = F.greatest(F.lit(0.0), F.coalesce(ms / 1000.0, F.lit(0.0)))
    return F.format_string("%02d:%02d.%02d", _whole(sec / 60), _whole(sec % 60), _whole((sec * 100) % 100))


def format_size(size_bytes: Column) -> Column:
    mb = size_bytes / F.lit(1048576.0)
    return F.when(mb >= 1000, F.format_string("%.1f GB", mb / 1024)).otherwise(F.format_string("%.1f MB", mb))


def age_bucket(ts_ms: Column, now_ms: int, mode: str = "rounded") -> Column:
    """Struct(unit, n). ``rounded``: minutes, hours and days rounded half up;
    ``floored``: whole units down to weeks, months of 30 and years of 365 days."""
    ms = F.lit(now_ms) - ts_ms

    def pick(*cases, last):
        out = None
        for cond, unit, n in cases:
            value = F.struct(F.lit(unit).alias("unit"), n.cast("bigint").alias("n"))
            out = F.when(cond, value) if out is None else out.when(cond, value)
        unit, n = last
        return out.otherwise(F.struct(F.lit(unit).alias("unit"), n.cast("bigint").alias("n")))

    zero, one = F.lit(0), F.lit(1)
    if mode == "rounded":
        def near(c):
            return _whole(c + 0.5)

        minutes = near(ms / 60000)
        hours = near(minutes / 60)
        days = near(hours / 24)
        return pick(
            (minutes < 1, "now", zero), (minutes < 60, "min", minutes), (hours < 24, "h", hours),
            (days == 1, "yesterday", one), last=("days", days),
        )
    sec = _whole(ms / 1000)
    days = _whole(sec / 86400)
    return pick(
        (sec < 60, "moment", zero), (sec < 3600, "min", _whole(sec / 60)), (sec < 86400, "h", _whole(sec / 3600)),
        (days == 1, "yesterday", one), (days < 7, "days", days), (days < 30, "weeks", _whole(days / 7)),
        (days < 365, "months", _whole(days / 30)), last=("years", _whole(days / 365)),
    )


def name_code(new_name: Column, taken: Column, unchanged: Column) -> Column:
    name = strip(new_name)
    return (
        F.when(name == "", "empty")
        .when(name.rlike(BAD_NAME_CHARS), "chars")
        .when(unchanged, "ok")
        .when(taken, "exists")
        .otherwise("ok")
    )


def source_label(target: Column, game: Column, word: str = "Pantalla") -> Column:
    """Label of a capture target: the current game for "window", the numbered screen for
    ...DISPLAYn, the bare word for anything else, '' for none."""
    number = F.regexp_extract(target, r"(?s)^.*DISPLAY\+?([0-9]+)$", 1).try_cast("bigint")
    return (
        F.when(target.isNull(), "")
        .when(target == "window", F.coalesce(game, F.lit("")))
        .when(number <= 4294967295, F.concat(F.lit(word + " "), number.cast("string")))
        .otherwise(word)
    )


def shape_message(message: Column, lines: int = 4, width: int = 2000) -> Column:
    """First lines of a stack joined with a bar, cut to the width the log accepts."""
    return F.left(F.array_join(F.slice(F.split(message, "\n"), 1, lines), " | "), F.lit(width))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
