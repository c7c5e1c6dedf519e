"""Log lines: parsing, own targets, daily files with a byte budget and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clipgrove.operators.scan import Run, rows_chunk, running
from clipgrove.session import cut
from clipgrove.sources.versions import Versions

# Fixed values.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\S+)\s+([^\s]*?): ([\s\S]*)$"
MAX_DAY_BYTES = 5 * 1024 * 1024
KEEP_DAYS = 7
LEVELS = ("ERROR", "WARN", "INFO")


def parse_line(line: Column) -> list[Column]:
    return [
        F.regexp_extract(line, LINE, 1).alias("ts"), F.substring(line, 1, 10).alias("day"), F.regexp_extract(line, LINE, 2).alias("level"),
        F.regexp_extract(line, LINE, 3).alias("module"), F.regexp_extract(line, LINE, 4).alias("message"),
    ]


def module_of(target: Column, crate: str) -> Column:
    """Target without the crate: 'app' for the crate itself, unknown targets as they are."""
    rest = F.substr(target, F.lit(len(crate) + 1))
    return F.when(target == crate, "app").when(F.startswith(target, F.lit(crate)), F.regexp_replace(rest, "^:+", "")).otherwise(target)


def own_logs(df: DataFrame, crate: str, target: str = "target", level: str | None = None) -> DataFrame:
    t = F.col(target)
    keep = (t == "ui") | (t == crate) | F.startswith(t, F.lit(crate + "::"))
    if level:
        keep = keep & F.col(level).isin(*LEVELS)
    return df.where(keep)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", *parse_line(F.col("value")))


def byte_budget(df: DataFrame, cap: int = MAX_DAY_BYTES, line: str = "line", order: str = "n", keys: tuple[str, ...] = ("day",), used: DataFrame | None = None) -> DataFrame:
    """df(<keys>, <order>, <line>): lines of a day while their bytes (with the line end) fit; the first
    that does not closes the day and leaves one notice in its place. ``cap`` is the limit of one file: with lines of several machines
    ``keys`` are machine and day. ``used`` (<keys>, bytes, closed): what earlier calls have written."""
    by = list(keys)
    size = (F.octet_length(line) + 1).cast("bigint")
    run = running(df, by, [order], {"_bytes": Run("sum", size)}, rows_chunk(order)).withColumn("notice", F.lit(False))
    if used is not None:
        run = run.join(used.select(*by, "bytes", "closed"), by, "left").where(~F.coalesce("closed", F.lit(False))).withColumn(
            "_bytes", F.col("_bytes") + F.coalesce("bytes", F.lit(0))).drop("bytes", "closed")
    kept = run.where(F.col("_bytes") <= cap).drop("_bytes")
    full = run.where(F.col("_bytes") > cap).groupBy(*by).agg(F.min(order).alias(order))
    note = F.concat("day", F.lit(f" 23:59:59.999 WARN  logs: day limit of {cap} bytes reached"))
    return kept.select(*by, order, line, "notice").unionByName(full.select(*by, order, note.alias(line), F.lit(True).alias("notice")))


def keep_last(df: DataFrame, n: int = KEEP_DAYS, pattern: str = r"^log-.*\.log$", name: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """The last ``n`` matching names by name, of each ``keys`` (machine); others stay."""
    dated = F.col(name).rlike(pattern)
    if not keys:
        last = F.broadcast(df.where(dated).select(name).distinct().orderBy(F.col(name).desc()).limit(n))
    else:
        one = df.where(dated).select(*keys, name).distinct()
        last = one.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(name).desc()))).where(F.col("_no") <= n).drop("_no")
    return df.where(~dated).unionByName(df.where(dated).join(last, [*keys, name], "left_semi").select(*df.columns))


DAILY = "line string, n bigint, notice boolean"
COMPACT = 16


def write_daily(df: DataFrame, path: str, max_bytes: int = MAX_DAY_BYTES, keep_days: int = KEEP_DAYS, machine: str | None = None, batch: int | None = None) -> bool:
    """df(line, n[, <machine>]): the lines of each day (and machine) within its budget, days beyond the retention dropped. Bytes that
    earlier calls wrote count, and a day that is closed stays closed; both are kept as a row per day beside the lines.

    ``batch`` numbers the calls, rising. A call that fails half way leaves what was there, and one whose number has been written
    changes nothing, so a call may be repeated; without ``batch`` every call is a new one. Returns whether it wrote. After COMPACT
    calls the lines are written together, so the number of folders is bounded."""
    spark = df.sparkSession
    keys = ([machine] if machine else []) + ["day"]
    table = Versions(spark, path)
    state = table.state or {"batch": -1, "live": [], "lines": [], "totals": None}
    number = state["batch"] + 1 if batch is None else batch
    if number <= state["batch"]:
        return False
    lines = df.withColumn("day", F.substring("line", 1, 10)).select(*keys, "n", "line")
    kinds = {k: lines.schema[k].dataType.simpleString() for k in keys}
    days = lines.select(*keys).distinct()
    used = None
    if state["totals"]:
        used = spark.read.schema(_totals(kinds)).parquet(table.folder(state["totals"]))
        days = days.unionByName(used.select(*keys)).distinct()
    last = keep_last(days.withColumnRenamed("day", "name"), keep_days, ".*", keys=tuple(keys[:-1])).withColumnRenamed("name", "day")
    last = cut(last)  # a row per kept day
    out = byte_budget(lines.join(last, keys, "left_semi"), max_bytes, keys=tuple(keys), used=used)
    name = f"b{number}"
    whole = len(state["lines"]) + 1 >= COMPACT
    if whole:
        out = out.unionByName(_lines(table, state).join(last, keys, "left_semi").select(*out.columns))
    out.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(table.folder(f"{name}/lines"))
    size = F.when(~F.col("notice"), F.octet_length("line") + 1)
    new = spark.read.schema(_line_schema(kinds)).parquet(table.folder(f"{name}/lines")).groupBy(*keys).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.max("notice").alias("closed"))
    if used is not None and not whole:
        new = new.unionByName(used.join(last, keys, "left_semi")).groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.max("closed").alias("closed"))
    new.repartition(1).write.mode("overwrite").parquet(table.folder(f"{name}/totals"))
    held = [f"{name}/lines"] if whole else [*state["lines"], f"{name}/lines"]
    table.commit({"batch": number, "live": sorted({f.partition("/")[0] for f in held} | {name}), "lines": held, "totals": f"{name}/totals", "keys": kinds})
    return True


def _totals(kinds: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", bytes bigint, closed boolean"


def _line_schema(kinds: dict[str, str]) -> str:
    return DAILY + "".join(f", `{k}` {t}" for k, t in kinds.items())


def _lines(table: Versions, state: dict) -> DataFrame:
    whole = None
    for f in state["lines"]:
        one = table.spark.read.schema(_line_schema(state["keys"])).parquet(table.folder(f))
        whole = one if whole is None else whole.unionByName(one)
    return whole if whole is not None else table.spark.createDataFrame([], _line_schema(state["keys"]))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``write_daily`` keeps: line, n, notice and the keys (machine, day). Days beyond the retention are left
    out at once; their files go with the next writing together."""
    table = Versions(spark, path)
    state = table.state
    if not state:
        return spark.createDataFrame([], _line_schema({"day": "string"}))
    kept = spark.read.schema(_totals(state["keys"])).parquet(table.folder(state["totals"])).select(*state["keys"])
    return _lines(table, state).join(kept, list(state["keys"]), "left_semi")
