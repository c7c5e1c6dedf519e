"""Merkle manifest of a dataset: an append log of tree nodes in postorder, with proofs by computed positions.

Every group of rows is a tree of 16 children per node; the roots of the groups are the leaves of one more tree. Leaves are numbered in
order. Builders take aligned blocks of 256 nodes of a level and append every node as soon as its last child is there, so the
entries of a tree stand in completion order. A complete subtree of height k has (16^(k+1) - 1) / 15 entries, so the place of
any node is a sum of such sizes over the digits of its last leaf: no pointers are kept, and a proof looks up the places of
its siblings. Blocks of two levels are built per pass, so the passes grow with the logarithm of the largest group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clipgrove.session import cut

BITS = 4  # of a child's number: 16 children
SPAN = 2  # levels that a builder makes
TOP = "top"
LOG = "tree string, position long, level int, number long, n long, digest string"


# ---- places


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return -(-(n - 1).bit_length() // BITS)


def position(level: int, number: int, n: int) -> int:
    """Place of a node in the log of a tree with ``n`` leaves."""
    last = min((number + 1) << BITS * level, n) - 1
    at, size, rest = level, 1, last
    while rest:
        at += (rest & (1 << BITS) - 1) * size
        size, rest = (size << BITS) + 1, rest >> BITS
    return at


def siblings(level: int, number: int, n: int) -> list[int]:
    """Places of all children of the node's parent, in order."""
    first = number >> BITS << BITS
    return [position(level, x, n) for x in range(first, min(first + (1 << BITS), (n - 1 >> BITS * level) + 1))]


# ---- digests


def leaf(**fields: Column) -> Column:
    """Lowercase hex sha256 of the fields: '-' for null, else the bytes of the text in UTF-8, ':' and the text."""
    text = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def up(h: Column, step: Column) -> Column:
        at = step["place"] * 64
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), at), h, F.substring(step["siblings"], at + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(proof, digest, up)


def _tree(group: Column) -> Column:
    """Key of a tree; sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, ...) plus number (in ``order`` within the tree, nulls first) and n (leaves of the tree).

    One range sort over (tree, order), so a hot tree spreads; numbers come from a row per sorted partition and tree."""
    spark = leaves.sparkSession
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = rows.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_rows").over(W.partitionBy("tree")).alias("n"))
    return rows.join(counts, ["tree", "_part"]).withColumn("number", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


# ---- the log


def _builder(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[str]] = {base + i: [] for i in range(SPAN)}
        for batch in batches:
            out: list[tuple] = []
            for tree, x, n, h in zip(*(batch.column(c).to_pylist() for c in ("tree", "number", "n", "digest"))):
                level = base
                if not base:
                    out.append((tree, position(0, x, n), 0, x, n, h))
                while level < min(base + SPAN, height(n)):
                    open_[level].append(h)
                    if x & 15 != 15 and x != n - 1 >> BITS * level:
                        break
                    h = sha256("".join(open_[level]).encode()).hexdigest()
                    open_[level].clear()
                    level, x = level + 1, x >> BITS
                    out.append((tree, position(level, x, n), level, x, n, h))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)],
                                  names=["tree", "position", "level", "number", "n", "digest"])

    return run


def _bases(most: int) -> range:
    return range(0, max(1, height(most)), SPAN)


def _height(n: Column) -> Column:
    """``height`` as a column."""
    return F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.call_function("shiftright", n - 1, k * BITS)), lambda x: x > 0))


def _block(number: str, levels: int) -> Column:
    return F.shiftright(number, BITS * levels)


def append(nodes: DataFrame, path: str) -> DataFrame:
    """Writes the log of the trees whose leaves are ``nodes`` (tree, number, n, digest) below ``path``, a folder per pass; the roots
    (tree, digest). A task holds the open nodes of one block."""
    spark = nodes.sparkSession
    most = nodes.agg(F.max("n")).first()[0] or 0
    below, roots = nodes.select("tree", "number", "n", "digest"), []
    for base in _bases(most):
        rows = below.withColumn("_block", _block("number", SPAN)).repartition("tree", "_block").sortWithinPartitions("tree", "number")
        rows.select("tree", "number", "n", "digest").mapInArrow(_builder(base), LOG).write.parquet(f"{path}/base={base}")
        made = read_log(spark, path, base)
        roots.append(made.filter(F.col("level") == _height(F.col("n"))).select("tree", "digest"))
        below = made.filter((F.col("level") == base + SPAN) & (_height(F.col("n")) > base + SPAN))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out


def read_log(spark: SparkSession, path: str, base: int) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{path}/base={base}")


# ---- proofs

STEPS = "array<struct<place: int, siblings: string>>"
_ASKED = {"kind": "int", "number": "long", "n": "long", "digest": "string", "position": "long", "proof": STEPS, "subroot": "string", "id": "long", "seen": "string"}
_PROVED = f"tree string, number long, n long, digest string, subroot string, id long, seen string, proof {STEPS}"


def _prover(base: int):
    """Rows come by block: the proof of the block's top, the log entries of the block, the nodes that ask."""
    def proof(x: int, n: int, held: dict[int, str], above: tuple[list, list]) -> tuple[list, list]:
        places, texts = [], []
        for level in range(base, min(base + SPAN, height(n))):
            run = siblings(level, x, n)
            own = x & 15
            places.append(own)
            texts.append("".join([held[p] for i, p in enumerate(run) if i != own]))
            x >>= BITS
        return places + above[0], texts + above[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, above, subroot = None, {}, ([], []), None
        for batch in batches:
            names = batch.schema.names
            took, places, texts, ends, subroots = [], [], [], [0], []
            for i, r in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tree", "_block", "kind", "number", "n", "position", "digest", "proof", "subroot")))):
                if r[:2] != block:
                    block, held, above, subroot = r[:2], {}, ([], []), None
                if r[2] == 0:
                    above, subroot = ([s["place"] for s in r[7]], [s["siblings"] for s in r[7]]), r[8]
                elif r[2] == 1:
                    held[r[5]] = r[6]
                else:
                    a, b = proof(r[3], r[4], held, above)
                    took.append(i)
                    places += a
                    texts += b
                    ends.append(len(places))
                    subroots.append(subroot)
            own = batch.take(pa.array(took, pa.int64()))
            steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["place", "siblings"])
            keep = {c: own.column(names.index(c)) for c in ("tree", "number", "n", "digest")}
            yield pa.record_batch([*keep.values(), pa.array(subroots, pa.string()), own.column(names.index("id")), own.column(names.index("seen")),
                                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)],
                                  names=[*keep, "subroot", "id", "seen", "proof"])

    return run


def _stream(base: int, *parts: DataFrame) -> DataFrame:
    """The parts, brought together by block."""
    whole = None
    for p in parts:
        full = p.select("tree", "_block", *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in _ASKED.items()])
        whole = full if whole is None else whole.unionByName(full)
    return whole.repartition("tree", "_block").sortWithinPartitions("tree", "_block", "kind").mapInArrow(_prover(base), _PROVED)


def proofs(asked: DataFrame, path: str, tops: DataFrame) -> DataFrame:
    """``asked`` (tree, number, n, digest, id, seen) plus proof and subroot. ``tops``: tree, n, subroot, proof of each tree's root. From the top
    pass down: the proof of a block's top is the end of the proofs of all nodes in it, so it is made once per block."""
    spark = asked.sparkSession
    most = asked.agg(F.max("n")).first()[0] or 0
    made = None
    for base in reversed(_bases(most)):
        tall = _height(F.col("n"))
        here = tops.filter((tall <= base + SPAN) & ((tall > base) | (F.lit(base) == 0))).select("tree", F.lit(0).cast("long").alias("_block"), F.lit(0).alias("kind"), "proof", "subroot")
        if made is not None:
            here = here.unionByName(made.select("tree", F.col("number").alias("_block"), F.lit(0).alias("kind"), "proof", "subroot"))
        log = read_log(spark, path, base)
        if base:  # the lowest level of this block was written by the pass before
            log = log.unionByName(read_log(spark, path, base - SPAN).filter((F.col("level") == base) & (tall > base)))
        log = log.filter(F.col("level") < base + SPAN)
        entries = log.select("tree", F.when(F.col("level") == base, _block("number", SPAN)).otherwise(_block("number", SPAN - 1)).alias("_block"),
                             F.lit(1).alias("kind"), "number", "n", "position", "digest")
        nodes = asked if base == 0 else read_log(spark, path, base - SPAN).filter((F.col("level") == base) & (tall > base))
        nodes = nodes.withColumn("_block", _block("number", SPAN)).withColumn("kind", F.lit(2))
        made = _stream(base, here, entries, nodes)
    return made


# ---- the manifest


def manifest(rows: DataFrame, path: str) -> DataFrame:
    """The manifest of ``rows``: id long, group string, leaf and seen (hex digests). Writes the logs below ``path`` and reads the proofs from them.

    Returns per row: id, leaf, seen, subroot (root of its group), root (of all), proof (array of place, siblings: the place of the own node
    among its parent's children and the digests of the others, from the leaf up). ``seen`` is passed on: the digest that a check of the data
    found, for ``fold``. Leaves of a group are in the order of id (null first), those of equal ids in the order of their digests, so repeated
    rows are leaves of their own and the root does not depend on the order of the input. A null group is one group, before all others; groups
    are in the order of their bytes. A group of one leaf has it as its root; one group is its own root. An empty table writes empty logs and
    gives no rows. Only the numbers and digests of rows are shuffled."""
    spark = rows.sparkSession
    leaves = numbered(rows.select(_tree(F.col("group")).alias("tree"), F.col("id").cast("long").alias("id"), F.col("leaf").alias("digest"), "seen"), ["id", "digest"])
    leaves = cut(leaves)
    subroots = append(leaves, f"{path}/groups").withColumnRenamed("tree", "name")
    tops = cut(numbered(subroots.select(F.lit(TOP).alias("tree"), "name", "digest"), ["name"]))
    root = append(tops, f"{path}/{TOP}").first()
    one = tops.select("tree", "n").distinct().select("tree", "n", F.lit(None).cast("string").alias("subroot"), F.array().cast(STEPS).alias("proof"))
    over = proofs(tops.select("tree", "number", "n", "digest", F.lit(None).cast("long").alias("id"), F.col("name").alias("seen")), f"{path}/{TOP}", one)
    sizes = leaves.select("tree", "n").distinct()
    over = over.select(F.col("seen").alias("tree"), F.col("digest").alias("subroot"), "proof").join(sizes, "tree")
    out = proofs(leaves, f"{path}/groups", cut(over))
    return out.select("id", F.col("digest").alias("leaf"), "seen", "subroot", F.lit(root["digest"] if root else None).alias("root"), "proof")
