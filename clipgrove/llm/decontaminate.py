"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of passages to test items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clipgrove.llm.bits import bit_filter, passes
from clipgrove.llm.words import lists, mix, signed, text_slices, word_hashes, word_spans
from clipgrove.session import cut

AWAY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``words`` per seed; ``longer``: words of the seeds in place of those that more than ``items`` items have; ``reach``: words that a passage has on either side of a seed, as a multiple of the longest item;
    ``match``, ``other`` and ``gap`` score the alignment; ``least``: share of the best possible score of the
    item from which on a document counts as contaminated; ``filter_bits``: size of the seed filter."""

    words: int = 3
    longer: tuple[int, ...] = (5, 8)
    items: int = 8
    reach: float = 1.25
    match: float = 2.0
    other: float = -1.0
    gap: float = -1.0
    least: float = 0.5
    filter_bits: int = 1 << 24


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last ones run over the end."""
    x = np.zeros(len(h), np.uint64)
    for i in range(n):
        x = x * AWAY
        x[:len(h) - i] += h[i:]
    return mix(x)


def _item_words(s: Settings):
    """item_id, its word hashes, and for every place its seeds of each length (n, gram). A longer seed that would run over
    the end lies at the end; an item that is too short for it keeps the seed before."""

    def seeds_of(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        m = len(h)
        n = min(s.words, max(1, m))
        count = max(0, m - n + 1)
        out = [(n, _grams(h, n)[:count])]
        for k in s.longer:
            out.append((k, _grams(h, k)[np.minimum(np.arange(count), m - k)]) if m >= k else out[-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("text")):
                start, end, before = word_spans(data, offs, plain=True)
                h = word_hashes(data, start, end)
                made = [seeds_of(h[x:y]) for x, y in zip(before[:-1], before[1:])]
                cols = [batch.column("item_id").slice(a, b - a), lists(signed(h), before, pa.int64())]
                for k in range(1 + len(s.longer)):
                    at = np.concatenate([[0], np.cumsum([len(x[k][1]) for x in made])])
                    cols.append(lists(signed(np.concatenate([x[k][1] for x in made])) if made else np.zeros(0, np.int64), at, pa.int64()))
                    cols.append(pa.array([x[k][0] for x in made], pa.int32()))
                yield pa.record_batch(cols, names=["item_id", "words", *[f"{c}{k}" for k in range(1 + len(s.longer)) for c in ("seeds", "n")]])

    return run


def _chosen(items: DataFrame, s: Settings) -> DataFrame:
    """item_id, n, seed: at every place of an item the shortest seed that at most ``items`` items have, else the longest. So a
    passage meets few items per seed, whatever phrases the items have in common."""
    levels = range(1 + len(s.longer))
    zipped = F.arrays_zip(*[F.col(f"seeds{k}").alias(f"s{k}") for k in levels])
    places = cut(items.select("item_id", *[f"n{k}" for k in levels], F.explode(zipped).alias("p")).select("item_id", *[f"n{k}" for k in levels], "p.*"))
    rows, pick = places, None
    for k in levels[:-1]:
        often = places.select("item_id", f"s{k}").distinct().groupBy(f"s{k}").agg(F.count("*").alias("c")).filter(F.col("c") > s.items).select(f"s{k}", F.lit(True).alias(f"often{k}"))
        rows = rows.join(often, f"s{k}", "left")
    for k in reversed(levels):
        own = F.struct(F.col(f"n{k}").alias("n"), F.col(f"s{k}").alias("seed"))
        pick = own if pick is None else F.when(F.col(f"often{k}").isNull(), own).otherwise(pick)
    return cut(rows.select("item_id", pick.alias("p")).select("item_id", "p.*").distinct())


def _passages(shared, s: Settings):
    """Passages around the words whose n-grams pass the filter: doc_id, start, words, seeds in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, reach, lengths = shared.value
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("text")):
                start, end, before = word_spans(data, offs, plain=True)
                h = word_hashes(data, start, end)
                if not len(h):
                    continue
                last = np.repeat(before[1:], np.diff(before))
                rows, places, seeds = [], [], []
                for n in sorted({s.words, *lengths}):
                    g = _grams(h, n)
                    hit = np.flatnonzero(passes(g, bits) & (np.arange(len(h)) + n <= last))
                    places.append(hit)
                    seeds.append(g[hit])
                place, seed = np.concatenate(places), np.concatenate(seeds)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                doc = np.searchsorted(before, place, side="right") - 1
                new = np.concatenate([[True], (np.diff(place) > 2 * reach) | (np.diff(doc) > 0)])
                first = np.flatnonzero(new)
                final = np.append(first[1:], len(place))
                for x, y in zip(first, final):
                    d = doc[x]
                    lo, hi = max(before[d], place[x] - reach), min(before[d + 1], place[y - 1] + reach)
                    rows.append((a + d, lo - before[d], h[lo:hi], seed[x:y]))
                take = pa.array([r[0] for r in rows])
                cols = [batch.column("doc_id").take(take), pa.array([int(r[1]) for r in rows])]
                for k in (2, 3):
                    at = np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])])
                    cols.append(lists(signed(np.concatenate([r[k] for r in rows])), at, pa.int64()))
                yield pa.record_batch(cols, names=["doc_id", "start", "words", "seeds"])

    return run


def align(items: list[np.ndarray], passages: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman score of each item in its passage, and the first and last word of the best place.

    All pairs advance together, one item word at a time; a row's gaps are a running maximum. Ties go to
    the earliest end, then to the alignment found first."""
    n, m, width = len(items), max(map(len, items)), max(map(len, passages))
    p = np.zeros((n, width), np.uint64)
    inside = np.zeros((n, width), bool)
    q = np.zeros((n, m), np.uint64)
    deep = np.array([len(x) for x in items])
    for i, (x, y) in enumerate(zip(items, passages)):
        q[i, :len(x)] = x
        p[i, :len(y)] = y
        inside[i, :len(y)] = True
    ramp = -s.gap * np.arange(width + 1)
    score = np.zeros((n, width + 1))
    origin = np.broadcast_to(np.arange(width + 1), (n, width + 1)).copy()
    best, begin, end = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(m):
        step = np.where((p == q[:, i:i + 1]) & inside, s.match, s.other)
        diag = score[:, :-1] + step
        up = score + s.gap
        new = np.zeros_like(score)
        new[:, 1:] = np.maximum(diag, up[:, 1:])
        source = np.concatenate([origin[:, :1], np.where(diag >= up[:, 1:], origin[:, :-1], origin[:, 1:])], axis=1)
        source = np.where(new > 0, source, np.arange(width + 1))
        new = np.maximum(new, 0)
        lifted = new + ramp
        run = np.maximum.accumulate(lifted, axis=1)
        at = np.maximum.accumulate(np.where(lifted >= run, np.arange(width + 1), 0), axis=1)
        gapped = run - ramp
        source = np.where(gapped > new, np.take_along_axis(source, at, axis=1), source)
        score = np.maximum(new, gapped)
        score[:, 1:][~inside] = 0
        score[i >= deep] = 0
        origin = source
        top = score.argmax(axis=1)
        value = score[rows, top]
        better = value > best
        best[better], end[better], begin[better] = value[better], top[better], origin[rows, top][better]
    return best, begin, end


def at_most(items: list[np.ndarray], passages: list[np.ndarray], s: Settings) -> np.ndarray:
    """A bound on the Smith-Waterman score of each item in its passage: every word of either side that an alignment covers
    is matched, if the other side has it at all, or costs. So no score is above the best stretch of each side on its own."""

    def best(own: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
        deep = np.array([len(x) for x in own])
        row = np.repeat(np.arange(len(own), dtype=np.uint64), deep)
        there = np.repeat(np.arange(len(own), dtype=np.uint64), [len(x) for x in others])
        known = np.isin(mix(np.concatenate(own) + row * AWAY), mix(np.concatenate(others) + there * AWAY))
        gain = np.zeros((len(own), deep.max() + 1))
        gain[:, 1:][np.arange(deep.max()) < deep[:, None]] = np.where(known, s.match, max(s.other, s.gap))
        total = gain.cumsum(axis=1)
        return (total - np.minimum.accumulate(total, axis=1)).max(axis=1)

    return np.minimum(best(items, passages), best(passages, items))


def _aligner(s: Settings, cells: int = 1 << 17):
    names = ["doc_id", "item_id", "score", "identity", "word_from", "word_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column("words"), batch.column("item_words")
            wide = np.diff(np.frombuffer(p.buffers()[1], np.int32)[p.offset:p.offset + len(p) + 1])
            order, at = np.argsort(wide, kind="stable"), 0
            while at < len(order):
                end = at + 1
                while end < len(order) and int(wide[order[end]] + 1) * (end + 1 - at) <= cells:
                    end += 1
                part = batch.take(pa.array(order[at:end]))
                at = end
                items = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in part.column("item_words")]
                texts = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in part.column("words")]
                may = np.flatnonzero(at_most(items, texts, s) / (s.match * np.array([max(1, len(x)) for x in items])) >= s.least)
                if not len(may):
                    continue
                part, items, texts = part.take(pa.array(may)), [items[i] for i in may], [texts[i] for i in may]
                best, lo, hi = align(items, texts, s)
                share = best / (s.match * np.array([max(1, len(x)) for x in items]))
                keep = share >= s.least
                start = np.array(part.column("start").to_pylist())
                mask = pa.array(keep)
                yield pa.record_batch([part.column("doc_id").filter(mask), part.column("item_id").filter(mask), pa.array(best[keep]), pa.array(share[keep]),
                                       pa.array((start + lo)[keep]), pa.array((start + hi)[keep])], names=names)

    return run


def candidates(docs: DataFrame, items: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(passages: doc_id, start, words, seeds; pairs: doc_id, start, item_id) that share a seed."""
    seeds = _chosen(items, s)
    longest, = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    lengths = [r[0] for r in seeds.select("n").distinct().collect()]  # a few numbers: words, longer ones and those of short items
    shared = docs.sparkSession.sparkContext.broadcast((bit_filter(seeds, "seed", s.filter_bits), int(longest * s.reach) + s.words, lengths))
    found = cut(docs.mapInArrow(_passages(shared, s), "doc_id long, start long, words array<long>, seeds array<long>"))
    hits = (found.select("doc_id", "start", F.explode(F.array_distinct("seeds")).alias("seed")).join(seeds.select("item_id", "seed"), "seed")
            .select("doc_id", "start", "item_id").distinct())
    return found, hits


def contaminated(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, identity (share of the item's best possible score), word_from, word_to (words
    of the document that the best alignment covers, the end not included), for every document and test item with
    an alignment of at least ``least``. Ties go to the earliest place.

    A filter of fixed size picks the documents' n-grams that may be seeds, and passages around them; the real seeds come by a join. Every
    run of ``words`` words of an item is a seed, unless more than ``items`` items have it; then the run of 5, or else 8, words there is
    the seed. How rare a seed is goes by the items alone, so what other documents hold changes nothing, and copies of an item make none
    of its seeds frequent. A passage is aligned to every item that it shares a seed with, unless a bound on the score (``at_most``)
    rules it out: one row per passage and item, at most ``items`` for each seed in it but those of eight words that still more
    items share. An alignment without such a run (every third word changed, at a share of 0.5, or only phrases in common that many
    items have) is not found. Words are runs of letters and digits in lower case. Documents and items that are null, empty or without words match nothing;
    rows with a null id are ignored; repeated rows of an item count once (the first words), repeated
    documents give their pairs once. Only the id and text columns are read."""
    s = settings
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    schema = "item_id long, words array<long>" + "".join(f", seeds{k} array<long>, n{k} int" for k in range(1 + len(s.longer)))
    items = cut(tests.mapInArrow(_item_words(s), schema).filter(F.size("words") > 0).dropDuplicates(["item_id"]))
    found, hits = candidates(docs, items, s)
    pairs = (hits.join(found.select("doc_id", "start", "words").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
             .join(items.select("item_id", F.col("words").alias("item_words")), "item_id"))
    out = pairs.mapInArrow(_aligner(s), "doc_id long, item_id long, score double, identity double, word_from long, word_to long")
    first = F.min_by(F.struct("score", "identity", "word_from", "word_to"), F.struct(-F.col("score"), F.col("word_to"), F.col("word_from")))
    return out.groupBy("doc_id", "item_id").agg(first.alias("x")).select("doc_id", "item_id", "x.*")
