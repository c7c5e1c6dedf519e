"""Running values over long groups.

A plain window puts a whole group into one task. Here every group is cut into chunks of
its order column: windows run inside (keys, chunk), one aggregate row per chunk is carried
forward over the (few) chunks of a key, and both are added up. The big side is shuffled
once, on (keys, chunk), so one hot key spreads over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 1 << 20


@dataclass(frozen=True)
class Run:
    """``kind``: sum, max, min or last (last non-null). ``inclusive``: with the row itself.
    ``reverse``: over the rows behind instead of the rows before."""

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def count(inclusive: bool = True) -> Run:
    return Run("sum", F.lit(1).cast("bigint"), inclusive)


def rows_chunk(column: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense integer order column."""
    return F.floor(F.col(column) / F.lit(rows)).cast("bigint")


def span_chunk(column: str, width: int) -> Column:
    """Chunk of a time column; ``width`` in the unit of the column."""
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


_LOCAL = {
    "sum": F.sum, "max": F.max, "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _join(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, Run], chunk: Column) -> DataFrame:
    """``df`` plus one column per entry of ``outs``: the running value over the rows of the
    same ``keys`` in ``order``. ``chunk`` must not decrease along ``order``. Values over no row are
    NULL. Forward and backward values share one shuffle."""
    base = df.withColumn("_chunk", chunk)
    for i, run in enumerate(outs.values()):
        base = base.withColumn(f"_v{i}", run.value)
    at = F.struct(*order)

    def by(columns: list[str], reverse: bool) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in columns]

    local, totals, carries, done = base, [], [], []
    for i, (name, run) in enumerate(outs.items()):
        v, merge = F.col(f"_v{i}"), _LOCAL[run.kind]
        inside = W.partitionBy(*keys, "_chunk").orderBy(*by(order, run.reverse)).rowsBetween(W.unboundedPreceding, 0 if run.inclusive else -1)
        across = W.partitionBy(*keys).orderBy(*by(["_chunk"], run.reverse)).rowsBetween(W.unboundedPreceding, -1)
        local = local.withColumn(f"_l{i}", merge(v).over(inside))
        if run.kind == "last":
            pick = F.min_by if run.reverse else F.max_by
            totals.append(pick(v, F.when(v.isNotNull(), at)).alias(f"_t{i}"))
        else:
            totals.append(merge(v).alias(f"_t{i}"))
        carries.append(merge(F.col(f"_t{i}")).over(across).alias(f"_c{i}"))
        done.append(_join(run.kind, F.col(f"_c{i}"), F.col(f"_l{i}")).alias(name))
    carry = base.groupBy(*keys, "_chunk").agg(*totals).select(*keys, "_chunk", *carries)
    # Nothing comes before the first chunk of a key, so short keys send no row.
    carry = carry.where(reduce(or_, [F.col(f"_c{i}").isNotNull() for i in range(len(outs))]))
    joined = local.join(carry, [*keys, "_chunk"], "left")
    return joined.select(*[c for c in df.columns if c not in outs], *done)


def neighbours(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column,
    prev: dict[str, Column] | None = None, following: dict[str, Column] | None = None,
) -> DataFrame:
    """Values of the row before / after, NULL at the ends (lag and lead)."""
    sides = {"_prev": (prev or {}, False), "_next": (following or {}, True)}
    outs = {
        side: Run("last", F.struct(*[c.alias(n) for n, c in wanted.items()]), False, reverse)
        for side, (wanted, reverse) in sides.items() if wanted
    }
    run = running(df, keys, order, outs, chunk)
    found = [F.col(f"{side}.{n}").alias(n) for side, (wanted, _) in sides.items() for n in wanted]
    new = {n for wanted, _ in sides.values() for n in wanted}
    return run.select(*[c for c in df.columns if c not in new], *found)


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of every key by a unique ``order``. Aggregates before the
    shuffle, so a key with many copies costs one row per task."""
    pick = F.max_by if last else F.min_by
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*named).agg(pick(row, F.struct(*order)).alias("_row")).select("_row.*")


def repack(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "idx") -> DataFrame:
    """Dense 0-based position by ``order`` inside ``keys``."""
    ranked = running(df, keys, order, {"_rows_before": count(inclusive=False)}, chunk)
    return ranked.withColumn(out, F.coalesce("_rows_before", F.lit(0)).cast("bigint")).drop("_rows_before")
