"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clipgrove.llm.words import mix, text_slices, word_hashes, word_spans


@dataclass(frozen=True)
class Settings:
    """``sample``: training rows at most (about: by a hash of doc_id, so the same rows at every run);
    ``bits``: log2 of the number of weights; ``alpha``, ``beta``: per-coordinate rates; ``l1``, ``l2``."""

    sample: int = 20_000
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    epochs: int = 4


@dataclass(frozen=True)
class Model:
    """Weights that are not 0 (``index`` ascending) and the bias; without ``rows`` it knows nothing."""

    rows: int
    bias: float
    index: np.ndarray
    weight: np.ndarray
    bits: int


def _features(h: np.ndarray, before: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the words, the pairs of neighbours and the pairs with one word between."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    kinds, rows = [mix(h)], [text]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = text[gap:] == text[:-gap]
        kinds.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
        rows.append(text[:-gap][same])
    return (np.concatenate(kinds) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def _featurise(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offs in text_slices(batch.column("text")):
        start, end, before = word_spans(data, offs, plain=True)
        yield a, b, *_features(word_hashes(data, start, end), before, bits)


def _examples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, f, row in _featurise(batch, bits):
                key = np.unique(row << bits | f)
                at = np.searchsorted(key, np.arange(b - a + 1) << bits)
                values = [(key[at[i]:at[i + 1]] & ((1 << bits) - 1)).astype(np.uint32).tobytes() for i in range(b - a)]
                yield pa.record_batch([batch.column("turn").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(values, pa.binary())],
                                      names=["turn", "label", "features"])

    return run


def ftrl(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, indexes, weights) after ``epochs`` passes over the rows, (features, label), in their order. The list is emptied as the rows
    are taken over, so they are in memory once."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias = 1 << s.bits

    def weights(i):
        zi = z[i]
        l1 = np.where(i == bias, 0.0, s.l1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    rows.reverse()
    taken = []
    while rows:
        f, y = rows.pop()
        taken.append((np.append(f.astype(np.int32), np.int32(bias)), y))
    for _ in range(s.epochs):
        for i, y in taken:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            before = n[i]
            after = before + g * g
            z[i] += g - (np.sqrt(after) - np.sqrt(before)) / s.alpha * w
            n[i] = after
    w = weights(np.arange(bias + 1))
    index = np.flatnonzero(w[:-1])
    return float(w[-1]), index, w[index]


def _trainer(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(f.as_py(), np.uint32), y) for b in batches for f, y in zip(b.column("features"), b.column("label").to_pylist())]
        n = len(rows)
        if n:
            bias, index, weight = ftrl(rows, s)
            yield pa.record_batch([pa.array([n]), pa.array([bias]), pa.array([index.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())],
                                  names=["n", "bias", "at", "weight"])

    return run


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model of ``labels`` (doc_id, label 0/1) over the texts of ``documents``.

    Labels are null-free after this: rows with a null id or label are ignored, repeated ids count once
    (1 wins). The bounded sample, and only it, meets in one task, which makes the passes in the order
    of a hash; the features are made in parallel. Other columns are not read. No usable row: a model
    that scores 0."""
    s = settings
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    share = min(1.0, s.sample / max(1, total))
    turn = F.xxhash64("doc_id", F.lit(11))
    chosen = known.withColumn("turn", turn).filter(turn < F.lit(int((share * 2 - 1) * 2**63) if share < 1 else 2**63 - 1))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("turn", "label", "text")  # at most ``sample`` pairs of numbers
    made = rows.mapInArrow(_examples(s.bits), "turn long, label int, features binary")
    got = made.repartition(1).sortWithinPartitions("turn", "features").mapInArrow(_trainer(s), "n long, bias double, at binary, weight binary").collect()
    if not got:
        return Model(0, 0.0, np.zeros(0, np.int64), np.zeros(0), s.bits)
    return Model(got[0].n, got[0].bias, np.frombuffer(bytes(got[0]["at"]), np.int64), np.frombuffer(bytes(got[0].weight), np.float64), s.bits)


def _scorer(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        dense = np.zeros(1 << model.bits)
        dense[model.index] = model.weight
        for batch in batches:
            score = np.zeros(len(batch))
            if model.rows:
                for a, b, f, row in _featurise(batch, model.bits):
                    hit = dense[f] != 0
                    key = np.unique(row[hit] << model.bits | f[hit])
                    total = np.bincount(key >> model.bits, dense[key & ((1 << model.bits) - 1)], b - a)
                    score[a:b] = 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))
            yield batch.append_column(name, pa.array(score))

    return run


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` plus the column ``name`` (a column of that name is replaced): 0 to 1, higher is more
    toxic. Each whole text is scored alone, from its words only; null and empty texts get the score of
    the bias. Weights that are 0 are not sent."""
    rest = documents.drop(name)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most 2^bits weights
    return rest.mapInArrow(_scorer(shared, name), StructType([*rest.schema.fields, StructField(name, DoubleType())]))
