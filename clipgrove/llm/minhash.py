"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.llm.bits import bit_filter, passes
from clipgrove.llm.graph import components
from clipgrove.llm.words import lists, mix, shingles, signed, text_slices, word_hashes, word_spans
from clipgrove.session import cut


@dataclass(frozen=True)
class Plan:
    """``words`` per shingle, ``percent`` of similarity, ``bands`` of ``rows`` minima, ``minima`` in all,
    ``bits`` kept of each. A pair at 0.8 misses all 42 bands of 6 with a chance of 3e-6. ``margin``:
    how far (about 5 standard deviations of the estimate) below the threshold a pair is still confirmed
    on full sets. ``block``: shingles on either side of a
    block of a bucket whose members are compared together."""

    words: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    minima: int = 256
    bits: int = 2
    margin: float = 0.16
    block: int = 1 << 17
    seed: int = 7


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>"


def _distinct(s: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(s[at[d]:at[d + 1]]) for d in range(len(at) - 1)]


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, offs in text_slices(batch.column("text")):
        start, end, before = word_spans(data, offs)
        yield a, b, _distinct(*shingles(word_hashes(data, start, end), before, n))


def signer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(plan.seed)
        mul = (rng.integers(0, 1 << 31, plan.minima, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        add = rng.integers(0, 1 << 32, plan.minima, dtype=np.uint32)
        used = plan.bands * plan.rows
        salt = mix(np.arange(1, plan.bands + 1, dtype=np.uint64))
        for batch in batches:
            for a, b, sets in _sets(batch, plan.words):
                least = np.full((b - a, plan.minima), 0xFFFFFFFF, dtype=np.uint32)
                size = np.array([len(u) for u in sets], dtype=np.int64)
                key = np.zeros((b - a, 2), dtype=np.uint64)
                for d, u in enumerate(sets):
                    key[d] = u.sum(dtype=np.uint64), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    x = (u >> np.uint64(32)).astype(np.uint32)
                    for i in range(0, len(x), 512):
                        np.minimum(least[d], (x[i:i + 512, None] * mul + add).min(axis=0), out=least[d])
                planes = [np.packbits((least >> np.uint32(p)) & np.uint32(1), axis=1) for p in range(plan.bits)]
                sig = np.concatenate([np.ascontiguousarray(x).view(np.int64) for x in planes], axis=1)
                rows = least[:, :used].reshape(b - a, plan.bands, plan.rows).astype(np.uint64)
                band = np.broadcast_to(salt, rows.shape[:2]).copy()
                for r in range(plan.rows):
                    band = mix(band * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, r])
                yield pa.record_batch([
                    batch.column("doc_id").slice(a, b - a), pa.array(size), pa.array(signed(key[:, 0].copy())), pa.array(signed(key[:, 1].copy())),
                    lists(sig.reshape(-1), np.arange(b - a + 1) * sig.shape[1], pa.int64()),
                    lists(signed(band.reshape(-1)), np.arange(b - a + 1) * plan.bands, pa.int64()),
                ], names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"])

    return run


def set_maker(words: int, wanted):
    """Sets of the documents whose ids pass the filter; a join takes out the few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(passes(mix(ids.view(np.uint64)), bits)))
            for a, b, sets in _sets(batch, words):
                at = np.concatenate([[0], np.cumsum([len(u) for u in sets])])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), lists(signed(flat), at, pa.int64())], names=["doc_id", "shingles"])

    return run


def _read_sets(ids: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """id, shingles of the documents in ``ids`` (id); their texts are not shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, "id", hashed=False))
    return docs.mapInArrow(set_maker(plan.words, wanted), "doc_id long, shingles array<long>").withColumnRenamed("doc_id", "id").dropDuplicates(["id"])


def estimate(a: str, b: str, plan: Plan) -> Column:
    """Similarity by the bits in which two packed signatures agree, corrected for agreement by chance."""
    longs = plan.minima // 64
    other = [reduce(lambda x, y: x.bitwiseOR(y), [F.col(a)[p * longs + i].bitwiseXOR(F.col(b)[p * longs + i]) for p in range(plan.bits)])
             for i in range(longs)]
    agree = 1 - reduce(lambda x, y: x + y, [F.bit_count(x) for x in other]) / F.lit(plan.minima)
    chance = 0.5 ** plan.bits
    return (agree - F.lit(chance)) / F.lit(1 - chance)


def _likely(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures come near it."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"{c}_n"), F.col("sig").alias(f"{c}_sig"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.filter((F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * plan.percent)
                       & (estimate("a_sig", "b_sig", plan) >= plan.percent / 100 - plan.margin)).select("a", "b", "a_n", "b_n")


def _confirm(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _read_sets(ids, docs, plan)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .filter(both * 100 >= (F.col("a_n") + F.col("b_n") - both) * plan.percent).select("a", "b"))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(0, len(shared), 4096):
        part = shared[i:i + 4096]
        m = []
        for flat, sets in ((fa, a), (fb, b)):
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            ok = part[at] == flat
            x = np.zeros((len(sets), len(part)), np.float32)
            x[row[ok], at[ok]] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _prefixes(sets: list[np.ndarray], side: np.ndarray, k: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, shingle code) of the shingles that a link inside the block must share.

    With shingles ordered by frequency in the block, two sets that reach ``percent`` share one of the first
    n - ceil(n * percent / 100) + 1 of each. Of these only shingles on both sides and in more than one class count,
    so a line that many otherwise unlike members have in common brings none of them together."""
    n = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), n)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    code = rank[code]
    order = np.lexsort((code, member))
    member, code = member[order], code[order]
    place = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    ok = place <= (n - -(-n * percent // 100))[member]
    member, code = member[ok], code[ok]
    least, most = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), -1, np.int64)
    np.minimum.at(least, code, k[member])
    np.maximum.at(most, code, k[member])
    on = [np.isin(np.arange(len(count)), code[side[member] == s]) for s in (0, 1)]
    ok = (on[0] & on[1] & (least < most))[code]
    return member[ok], code[ok]


def _tiles(members: np.ndarray, codes: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Members, those of near shingle codes together, in pieces of ``size`` with the codes of each piece."""
    order = np.lexsort((codes, members))
    members, codes = members[order], codes[order]
    who, first = np.unique(members, return_index=True)
    turn = who[np.argsort(codes[first], kind="stable")]
    return [(t, np.unique(codes[np.isin(members, t)])) for t in (turn[i:i + size] for i in range(0, len(turn), size))]


def _block_links(percent: int, tile: int = 1024):
    """Links between the two sides of each block: at most one less than it has classes. Rows come sorted by block.
    Members are compared ``tile`` by ``tile``, so memory is that of the block and of one tile."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        names, k = np.unique(t["k"].to_numpy(), return_inverse=True)
        sets = [x.values.to_numpy() for x in t["shingles"].combine_chunks()]
        n = np.array([len(x) for x in sets])
        member, code = _prefixes(sets, side, k, percent)
        left, right = (_tiles(member[side[member] == s], code[side[member] == s], tile) for s in (0, 1))
        group, found = np.arange(len(names)), []  # classes joined so far
        for a, ca in left:
            for b, cb in right:
                if not len(np.intersect1d(ca, cb, assume_unique=True)):
                    continue
                both = _overlaps([sets[i] for i in a], [sets[i] for i in b])
                x, y = np.nonzero((both * 100 >= (n[a][:, None] + n[b][None] - both) * percent) & (group[k[a]][:, None] != group[k[b]][None]))
                pair = np.minimum(k[a[x]], k[b[y]]) * len(names) + np.maximum(k[a[x]], k[b[y]])
                for at in np.unique(pair, return_index=True)[1]:
                    i, j = a[x[at]], b[y[at]]
                    u, v = group[k[i]], group[k[j]]
                    if u != v:
                        group[group == max(u, v)] = min(u, v)
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.record_batch([pa.array([int(p[c]) for p in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            code = [batch.column(c).to_numpy() for c in ("key", "x", "y")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in code], axis=0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(batch)]):
                block = tuple(int(c[i]) for c in code)
                if held and block != now:
                    yield links(held)
                    held = []
                now = block
                held.append(batch.slice(i, j - i))
        if held:
            yield links(held)

    return run


def _edges(buckets: DataFrame, reps: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Links that join all similar members of every bucket (key, id).

    First every member is compared with one member of its bucket, another one in every band, so large groups
    of copies become one class in few comparisons. A member that is still outside the largest class of one of its buckets
    is then compared with all members of other classes there that share one of its rarest shingles, on full sets, in blocks of bounded size:
    no pairs are written, only links, and blocks of one bucket spread over all tasks."""
    turn = F.xxhash64("id", "key")
    first = buckets.groupBy("key").agg(F.min_by("id", F.struct(turn, F.col("id"))).alias("p"), F.count("*").alias("c")).filter("c > 1").select("key", "p")
    rows = cut(buckets.join(first, "key"))
    star = rows.filter("id <> p").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    found = cut(_confirm(cut(_likely(star, reps, plan)), docs, plan))
    classes = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = cut(rows.select("key", "id").join(classes, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("k")))
    top = (rows.groupBy("key", "k").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("k", F.struct("c", "k")).alias("top"), F.count("*").alias("classes"))
           .filter("classes > 1").select("key", "top"))
    inside = cut(rows.join(top, "key").join(reps.select("id", "n_shingles"), "id"))
    share = lambda c: F.ceil(F.coalesce(F.sum(c), F.lit(0)) / plan.block).cast("int")
    grid = inside.groupBy("key").agg(share(F.when(F.col("k") != F.col("top"), F.col("n_shingles"))).alias("xs"), share("n_shingles").alias("ys"))
    inside = inside.join(grid, "key")
    place = F.xxhash64("id", F.lit(3))
    other = inside.filter("k <> top").select("key", "id", "k", F.lit(0).alias("side"), F.pmod(place, "xs").cast("int").alias("x"),
                                             F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"))
    every = inside.select("key", "id", "k", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"),
                          F.pmod(place, "ys").cast("int").alias("y"))
    blocks = cut(other.unionByName(every))
    sets = _read_sets(blocks.select("id").distinct(), docs, plan)
    full = blocks.join(sets, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return found.unionByName(full.select("key", "x", "y", "side", "id", "k", "shingles").mapInArrow(_block_links(plan.percent), "a long, b long"))


def near_duplicates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked when 100 * intersection >= percent * union
    of their sets of word shingles.

    Copies of a set are one class and take part once. Texts with fewer words than a shingle have one
    shingle; empty and null texts have none, are linked with nothing and kept. doc_id is expected to be a
    unique long; rows with a null doc_id are dropped, repeated rows count once. Only doc_id and text are
    read, other columns may have any name. An empty table gives no rows."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    base = cut(docs.mapInArrow(signer(plan), SIGNED))
    sets = base.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"))
    member = base.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b").join(
        sets, ["set_a", "set_b", "n_shingles"]).select("doc_id", "id").distinct()
    reps = base.join(sets.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(
        F.col("doc_id").alias("id"), "n_shingles", "sig", "bands")
    buckets = reps.select("id", F.explode("bands").alias("key"))
    links = _edges(buckets, reps, docs, plan)
    classes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = (member.join(classes, "id", "left").select("doc_id", F.coalesce("component_id", "id").alias("component_id")))
    return (base.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]).join(of, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.col("component_id") == F.col("doc_id")))
