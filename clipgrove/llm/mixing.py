"""Mixing sources to target weights: a Pfair schedule of blocks.

Every source has an integer weight a out of Q, the sum over the sources that still have blocks. Its block j of a
phase is released at slot floor(j * Q / a) and due by ceil((j + 1) * Q / a); earliest deadline first fills the slots. So at
any slot of a phase every source has had less than one block more or less than its share. The schedule repeats
after Q slots, so one period of it, as arrays of slots per source, places any number of blocks. A phase ends when a
source has had its last block; the others go on in a new phase with their weights over the new sum.

Periods as arrays are for few sources. With more, the same schedule is made block by block, with heaps, in one task that
holds a row per source and writes a row per block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clipgrove.session import cut

MAX_SOURCES = 256
MAX_PERIOD = 100_000

# One period for weights a and their sum q: the source of each slot. c counts the blocks that each source has had.
_PERIOD = """
aggregate(sequence(0, q - 1), named_struct('c', transform(a, x -> 0), 'slots', cast(array() as array<int>)),
  (s, t) -> transform(array(array_min(filter(transform(a, (x, i) -> if(x > 0 and s.c[i] * q div x <= t,
      named_struct('due', -((-(s.c[i] + 1) * q) div x) + if((s.c[i] + 1) * q % x > 0, 1, 0), 'i', i), null)), y -> y is not null)).i),
    i -> named_struct('c', transform(s.c, (x, k) -> x + if(k = i, 1, 0)), 'slots', concat(s.slots, array(i))))[0]).slots
"""

# All phases. n: blocks left, b: blocks had, at: first slot. A source's blocks of a phase lie at places[j % a] + (j div a) * q.
_PHASES = f"""
aggregate(sequence(1, size(w)), named_struct('n', n, 'b', transform(n, x -> 0L), 'at', 0L, 'out', cast(array() as array<struct<
    at: bigint, q: int, a: array<int>, b: array<bigint>, got: array<bigint>, places: array<array<int>>>>)),
  (p, step) -> if(exists(p.n, x -> x > 0),
    transform(array(named_struct('a', transform(w, (x, i) -> if(p.n[i] > 0, x, 0)))), z ->
    transform(array(named_struct('a', z.a, 'q', aggregate(z.a, 0, (x, y) -> x + y))), z ->
    transform(array(named_struct('a', z.a, 'q', z.q, 'slots', transform(array(named_struct('a', z.a, 'q', z.q)), v -> PERIOD)[0])), z ->
    transform(array(named_struct('a', z.a, 'q', z.q, 'places', transform(z.a, (x, i) ->
      filter(transform(z.slots, (y, k) -> if(y = i, k, null)), y -> y is not null)))), z ->
    transform(array(named_struct('a', z.a, 'q', z.q, 'places', z.places, 'len', array_min(filter(transform(z.a, (x, i) ->
      if(x > 0, (p.n[i] - 1) div x * z.q + z.places[i][cast((p.n[i] - 1) % x as int)] + 1, null)), y -> y is not null)))), z ->
    transform(array(named_struct('a', z.a, 'q', z.q, 'places', z.places, 'len', z.len, 'got', transform(z.a, (x, i) ->
      z.len div z.q * x + size(filter(z.places[i], y -> y < z.len % z.q))))), z ->
    named_struct('n', transform(p.n, (x, i) -> x - z.got[i]), 'b', transform(p.b, (x, i) -> x + z.got[i]), 'at', p.at + z.len,
      'out', concat(p.out, array(named_struct('at', p.at, 'q', z.q, 'a', z.a, 'b', p.b, 'got', z.got, 'places', z.places))))
    )[0])[0])[0])[0])[0])[0], p)).out
""".replace("PERIOD", _PERIOD.strip().replace("size(a)", "size(v.a)").replace("(a, ", "(v.a, ").replace("q - 1", "v.q - 1").replace("* q ", "* v.q ").replace("* q)", "* v.q)"))


def phases(blocks: DataFrame) -> DataFrame:
    """``blocks`` (source, weight int > 0, blocks long) to one row per source and phase in which it has blocks:
    source, at (first slot of the phase), q, a, b (blocks of earlier phases), got, places (its slots in a period)."""
    one = blocks.filter("blocks > 0").agg(F.sort_array(F.collect_list(F.struct("source", "weight", "blocks"))).alias("s"))
    one = one.select("s", F.expr("transform(s, x -> x.weight)").alias("w"), F.expr("transform(s, x -> x.blocks)").alias("n"))
    every = one.select("s", F.explode(F.expr(_PHASES)).alias("p")).select("s", "p", F.explode(F.expr("sequence(0, size(s) - 1)")).alias("i"))
    return every.filter("p.a[i] > 0").select(
        F.expr("s[i].source").alias("source"), "p.at", "p.q", F.expr("p.a[i]").alias("a"), F.expr("p.b[i]").alias("b"), F.expr("p.got[i]").alias("got"),
        F.expr("p.places[i]").alias("places"))


def steps(sources: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(place of the source in the list, block, slot, release, due) of every block of ``sources`` (weight, blocks): the schedule of ``phases``.

    Sources that have had no block of the phase have equal dates if their weights are equal, so they wait in a heap per
    weight; the others are in ``ready`` by due slot or in ``later`` by release. A new phase moves only these, so the
    time is that of the blocks, whatever the number of phases."""
    left = [n for _, n in sources]
    fresh: dict[int, list[int]] = {}
    for i, (a, _) in enumerate(sources):
        fresh.setdefault(a, []).append(i)  # ascending, so a heap
    heavy = sorted(fresh, reverse=True)
    had = [0] * len(sources)  # in the phase
    block = [0] * len(sources)
    q, start, slot, ready, later = sum(a for a, _ in sources), 0, 0, [], []
    while q:
        t = slot - start
        while later and later[0][0] <= t:
            _, due, i = heapq.heappop(later)
            heapq.heappush(ready, (due, i))
        best = ready[0] if ready else None
        for a in heavy:
            due = -(-q // a)
            if best and due > best[0]:
                break  # lighter sources are due later
            if best is None or (due, fresh[a][0]) < best:
                best = due, fresh[a][0]
        due, i = best
        a = sources[i][0]
        if ready and ready[0] == best:
            heapq.heappop(ready)
        else:
            heapq.heappop(fresh[a])
            if not fresh[a]:
                del fresh[a]
                heavy.remove(a)
        yield i, block[i], slot, start + had[i] * q // a, start + due
        block[i] += 1
        had[i] += 1
        left[i] -= 1
        slot += 1
        if left[i]:
            heapq.heappush(later, (had[i] * q // a, -(-(had[i] + 1) * q // a), i))
            continue
        for k in (x[-1] for x in (*ready, *later)):
            had[k] = 0
            if sources[k][0] not in fresh:
                fresh[sources[k][0]] = []
                heavy = sorted(fresh, reverse=True)
            heapq.heappush(fresh[sources[k][0]], k)
        q, start, ready, later = q - a, slot, [], []


def _schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, sources = [], []
    for b in batches:
        names.append(b.column("source"))
        sources += zip(b.column("weight").to_pylist(), b.column("blocks").to_pylist())
    if not sources:
        return
    names, rows = pa.concat_arrays(names), []

    def pack():
        i, *rest = zip(*rows)
        return pa.record_batch([names.take(pa.array(i)), *(pa.array(x, pa.int64()) for x in rest)], names=["source", "block", "slot", "release", "due"])

    for row in steps(sources):
        rows.append(row)
        if len(rows) == 10_000:
            yield pack()
            rows = []
    if rows:
        yield pack()


def mix(documents: DataFrame, weights: DataFrame, block: int = 64, default: int = 1) -> DataFrame:
    """doc_id, source, block, slot, offset, release, due for every row of ``documents`` (doc_id, source): block
    ``block`` of its source comes in slot ``slot``; ``offset`` is its place in the block. Ordering by slot, offset
    is the mix.

    ``weights``: (source, weight), positive integers of at most MAX_PERIOD each. Any number of sources: beyond MAX_SOURCES, or a
    sum of weights beyond MAX_PERIOD, the same schedule is made block by block in one Python task, which takes
    no documents. Sources without a weight get ``default``. A null source counts as the empty name, in the
    result too. Within a source rows follow doc_id (nulls first); equal ids keep one row each in any order. Nothing is
    dropped; an empty table gives no rows; other columns are not read."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    # rank in the source: ranges of (source, doc_id) split hot sources; the place in a partition is in the row id
    rows = cut(ids.repartitionByRange(parts, "source", "doc_id").sortWithinPartitions("source", "doc_id").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    ranges = rows.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    ahead = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = ranges.select("source", "part", (ahead - F.col("first")).alias("base"))  # at most partitions + sources rows
    sizes = ranges.groupBy("source").agg(F.ceil(F.sum("c") / block).alias("blocks"))
    known = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("weight").cast("int").alias("weight")).filter("weight > 0")
    known = known.groupBy("source").agg(F.max("weight").alias("weight"))
    plan = sizes.join(known, "source", "left").select("source", F.coalesce("weight", F.lit(default)).alias("weight"), "blocks")
    n, q, most = plan.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    if most > MAX_PERIOD:
        raise ValueError(f"a weight of {most}: round the weights to at most {MAX_PERIOD}")
    few = n <= MAX_SOURCES and q <= MAX_PERIOD
    placed = rows.join(F.broadcast(base) if few else base, ["source", "part"]).withColumn("rank", F.col("at") + F.col("base"))
    placed = placed.select("doc_id", "source", F.floor(F.col("rank") / block).alias("block"), (F.col("rank") % block).cast("int").alias("offset"))
    if not few:
        order = cut(plan.repartition(1).sortWithinPartitions("source").mapInArrow(_schedule, "source string, block long, slot long, release long, due long"))
        return placed.join(order, ["source", "block"]).select("doc_id", "source", "block", "slot", "offset", "release", "due")
    found = placed.join(F.broadcast(phases(plan).withColumnRenamed("source", "s")), F.expr("source = s and block >= b and block < b + got"))
    j = "(block - b)"
    return found.select(
        "doc_id", "source", "block", F.expr(f"at + {j} div a * q + places[cast({j} % a as int)]").alias("slot"), "offset",
        F.expr(f"at + {j} * q div a").alias("release"), F.expr(f"at + (({j} + 1) * q + a - 1) div a").alias("due"))
