"""Token-ID files: whole texts as ids, compressed per shard by Re-Pair grammars.

A file row is a shard: the documents of one range of positions, in ascending order. Their ids are one
sequence of 16-bit symbols in which frequent pairs have been replaced by nonterminals, again and again.
Pairs never span documents, every document ends with the mark 0xFFFF (its end id), rules and the lengths
of their expansions are stored, so any document, and any id of it, is decoded without the others.
Rows lie in Parquet, so every store that Spark writes to will do and lost tasks are simply run again.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clipgrove.llm.words import lists, tables, text_slices, word_hashes, word_spans

MARK = 0xFFFF


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: path of a tokenizers file with fewer ids than 2^16 - 1; ``end``: id behind each document;
    ``shard``: ids from which on a shard is closed; ``least``: occurrences of a pair that becomes a rule; ``per_round``:
    pairs replaced together, the most frequent first; ``gain``: a round that shortens the sequence by less is the last;
    ``cache``: words kept per task."""

    tokenizer: str
    end: int = 1
    shard: int = 1 << 20
    least: int = 8
    per_round: int = 2048
    gain: float = 0.04
    cache: int = 1_000_000


# ---- encoding


class Encoder:
    """Ids of texts, word by word: the tokenizer drops white space and splits at it, so a word has the same
    ids anywhere. An open hash table from word hashes to ids answers whole slices; only new words are encoded. The bytes of a
    word are compared before it gets the ids of an earlier one, so words of equal hash are told apart. A tokenizer
    that is not of this kind is refused."""

    PLAIN = re.compile("[a-zß-öø-ÿ]+")
    PROBE = "It's THE Été, 12,000\t\n(x.y) naïve. e\u0301 日本\u00a0語 \U0001f600 don't a\u2009b"

    def __init__(self, s: Settings):
        from tokenizers import Tokenizer

        self.tok, self.s = Tokenizer.from_file(s.tokenizer), s
        self.model = self.tok.model
        self.slots = 1 << (2 * s.cache - 1).bit_length()
        known = sorted([*range(33, 127), *range(161, 173), *range(174, 256)])
        rest = [b for b in range(256) if b not in known]
        self.spelt = {b: chr(b) for b in known} | {b: chr(256 + i) for i, b in enumerate(rest)}  # fixed: bytes as the byte-level model spells them
        self.clear()
        if [i for w in self.PROBE.split() for i in self.ids(w.encode())] != self.tok.encode(self.PROBE, add_special_tokens=False).ids or any(
                self.tok.encode(f"a{c}", add_special_tokens=False).ids != self.ids(b"a") + self.ids(c.encode()) for c in ".,"):
            raise ValueError(f"{s.tokenizer}: words do not have the same ids anywhere")

    def clear(self):
        self.text_at = np.zeros(self.slots, np.int64)
        self.text_length = np.zeros(self.slots, np.int32)
        self.text = np.zeros(8 * self.s.cache, np.uint8)
        self.written = 0
        self.key = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.length = np.zeros(self.slots, np.int32)
        self.flat = np.zeros(4 * self.s.cache, np.uint16)
        self.used = self.fill = 0

    def ids(self, word: bytes) -> list[int]:
        if word.isascii() and word.isalpha():
            spelt = word.lower().decode()
        else:
            text = word.decode("utf-8", "replace")
            low = text.lower()
            if not (self.PLAIN.fullmatch(low) and unicodedata.is_normalized("NFC", text)):
                return self.tok.encode(text, add_special_tokens=False).ids
            spelt = low.encode().decode("latin-1").translate(self.spelt)
        return [t.id for t in self.model.tokenize(spelt)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or the free one where it belongs."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        open_ = np.flatnonzero((self.key[slot] != h) & (self.key[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            k = self.key[slot[open_]]
            open_ = open_[(k != h[open_]) & (k != 0)]
        return slot

    @staticmethod
    def lower(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bytes of the words, one after the other, A-Z as a-z."""
        if not len(size):
            return np.zeros(0, np.uint8)
        total = np.cumsum(size, dtype=np.int64)
        kind = np.int32 if max(total[-1], len(data)) < 1 << 31 else np.int64
        return tables().lower[data[np.arange(total[-1], dtype=kind) + np.repeat((start - total + size).astype(kind), size)]]

    def others(self, slot: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words that are not the ones in their slots."""
        size = (end - start).astype(np.int32)
        other = self.text_length[slot] != size
        same = np.flatnonzero(~other)
        n = size[same]
        before = np.cumsum(n, dtype=np.int64) - n
        kind = np.int32 if len(self.text) + int(n.sum()) < 1 << 31 else np.int64
        held = self.text[np.arange(int(n.sum()), dtype=kind) + np.repeat((self.text_at[slot[same]] - before).astype(kind), n)]
        wrong = np.flatnonzero(held != self.lower(data, start[same], n))
        other[same[np.searchsorted(before, wrong, side="right") - 1]] = True
        return np.flatnonzero(other)

    def add(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Takes in words with hashes that are all different and not in the table."""
        raw, ids = data.tobytes(), self.ids
        lists_ = [ids(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]
        n = np.fromiter(map(len, lists_), np.int32, len(lists_))
        at = self.fill + np.cumsum(n) - n
        flat = np.fromiter(chain.from_iterable(lists_), np.uint16, int(n.sum()))
        while self.fill + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.fill:self.fill + len(flat)] = flat
        self.fill += len(flat)
        self.used += len(h)
        size = (end - start).astype(np.int32)
        text_at = self.written + np.cumsum(size, dtype=np.int64) - size
        spelt = self.lower(data, start, size)
        while self.written + len(spelt) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.written:self.written + len(spelt)] = spelt
        self.written += len(spelt)
        left = np.arange(len(h))
        while len(left):  # of words with the same free slot one gets it, the others look on
            slot = self.find(h[left])
            _, one = np.unique(slot, return_index=True)
            w = left[one]
            self.key[slot[one]], self.at[slot[one]], self.length[slot[one]] = h[w], at[w], n[w]
            self.text_at[slot[one]], self.text_length[slot[one]] = text_at[w], size[w]
            left = np.delete(left, one)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text in them); no end ids."""
        start, end, before = word_spans(data, offs)
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(len(offs), np.int64)
        # a full stop or comma behind a letter is a word of its own, to the tokenizer too
        last, prior = data[end - 1], data[np.maximum(end - 2, 0)] | 32
        cut = ((last == 44) | (last == 46)) & (end - start > 1) & (prior >= 97) & (prior <= 122)
        moved = np.cumsum(cut)
        place = np.arange(len(start)) + moved - cut
        a, b = np.empty(len(start) + moved[-1], np.int64), np.empty(len(start) + moved[-1], np.int64)
        a[place], b[place] = start, end - cut
        a[place[cut] + 1], b[place[cut] + 1] = end[cut] - 1, end[cut]
        before = before + np.concatenate([[0], moved])[before]
        h = word_hashes(data, a, b) | np.uint64(1)
        slot = self.find(h)
        new = np.flatnonzero(self.key[slot] == 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            if self.used + len(first) > self.s.cache:
                self.clear()
                _, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
                if len(first) > self.slots // 2:
                    self.slots = 1 << (4 * len(first)).bit_length()
                    self.clear()
            f = new[first]
            self.add(h[f], data, a[f], b[f])
            slot = self.find(h)
        n, at, flat = self.length[slot], self.at[slot].astype(np.int64), self.flat
        other = self.others(slot, data, a, b)
        if len(other):  # their hashes are those of other words
            raw = data.tobytes()
            own = [self.ids(raw[x:y]) for x, y in zip(a[other].tolist(), b[other].tolist())]
            n[other] = [len(x) for x in own]
            at[other] = len(flat) + np.cumsum(n[other]) - n[other]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(own), np.uint16)])
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        take = np.repeat(at - total[:-1], n) + np.arange(total[-1])
        return flat[take], total[before]


def _encoder(s: Settings, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(s)
        for batch in batches:
            place = batch.column("position")
            part = np.searchsorted(edges, place.fill_null(-(2**63)).to_numpy(), side="left").astype(np.int32)
            for a, b, data, offs in text_slices(batch.column("text")):
                ids, at = enc.encode(data, offs)
                body = ids.tobytes()
                yield pa.record_batch([pa.array(part[a:b]), place.slice(a, b - a), batch.column("doc_id").slice(a, b - a),
                                       pa.array([body[2 * x:2 * y] for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["part", "position", "doc_id", "ids"])

    return run


# ---- Re-Pair


def repair(seq: np.ndarray, base: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(shorter sequence, rules): symbol ``base + i`` stands for the pair ``rules[i]``; MARK is in no pair.

    Every round counts all pairs of neighbours, takes the ``per_round`` most frequent ones with at least ``least``
    occurrences (ties: the smaller pair) and replaces their occurrences from left to right."""
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1:
        key = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        fit = (seq[:-1] != MARK) & (seq[1:] != MARK)
        ordered = np.sort(key[fit])
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        pair = ordered[first]
        often = np.flatnonzero(count >= s.least)
        room = min(s.per_round, MARK - base - made)
        if not len(often) or room <= 0:
            break
        often = often[np.argsort(-count[often], kind="stable")[:room]]
        pair = pair[often]
        # one slot of a small table per pair; of two pairs in one slot the more frequent one stays for this round
        hashed = lambda k: (k * np.uint32(2654435761)) >> np.uint32(14)
        _, keep = np.unique(hashed(pair), return_index=True)
        pair = pair[np.sort(keep)]
        table, rule = np.full(1 << 18, 0xFFFFFFFF, np.uint32), np.zeros(1 << 18, np.uint16)
        table[hashed(pair)] = pair
        rule[hashed(pair)] = np.arange(base + made, base + made + len(pair))
        slot = hashed(key)
        at = np.flatnonzero((table[slot] == key) & fit)
        # neighbours in a run of overlapping occurrences: every second one, from the left
        head = np.concatenate([[True], np.diff(at) > 1])
        run = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        at = at[run % 2 == 0]
        seq = seq.copy()
        seq[at] = rule[slot[at]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        rules.append(np.stack([pair >> np.uint32(16), pair & np.uint32(0xFFFF)], axis=1).astype(np.uint16))
        made += len(pair)
        before, seq = len(seq), seq[stay]
        if before - len(seq) < s.gain * before:
            break
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(length per symbol up to the last rule, flat expansions of the rules)."""
    length = np.ones(base + len(rules), np.int64)
    parts: list[np.ndarray] = []
    get = lambda x: parts[x - base] if x >= base else np.array([x], np.uint16)
    for i, (a, b) in enumerate(rules.tolist()):
        parts.append(np.concatenate([get(a), get(b)]))
        length[base + i] = len(parts[-1])
    return length, np.concatenate(parts) if parts else np.zeros(0, np.uint16)


class Shard:
    """One row of a token file; ``tokens`` and ``token`` decode only what is asked for."""

    def __init__(self, row: dict):
        self.base, self.end = row["base"], row["end_id"]
        self.symbols = np.frombuffer(row["symbols"], np.uint16)
        self.rules = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
        self.length = np.concatenate([np.ones(self.base, np.int64), np.frombuffer(row["rule_lengths"], np.uint32).astype(np.int64)])
        self.offset = np.frombuffer(row["offsets"], np.uint32).astype(np.int64)
        self._flat = None

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with their end ids, offset of each document in them)."""
        if self._flat is None:
            _, flat = expansions(self.rules, self.base)
            own = self.length[self.base:]
            self._flat = np.concatenate([np.arange(self.base, dtype=np.uint16), flat]), np.concatenate([np.arange(self.base), self.base + np.cumsum(own) - own])
        flat, start = self._flat
        last = self.symbols == MARK
        sym = np.where(last, self.end, self.symbols)
        n = self.length[sym]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[sym] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[self.offset]

    def tokens(self, document: int) -> np.ndarray:
        """All ids of one document, the end id included."""
        out: list[int] = []
        for x in self.symbols[self.offset[document]:self.offset[document + 1] - 1].tolist():
            stack = [x]
            while stack:
                x = stack.pop()
                if x < self.base:
                    out.append(x)
                else:
                    stack += [int(self.rules[x - self.base][1]), int(self.rules[x - self.base][0])]
        return np.array([*out, self.end], np.uint16)

    def token(self, document: int, i: int) -> int:
        """Id ``i`` of one document: lengths of expansions lead to its symbol, and down its rules."""
        sym = self.symbols[self.offset[document]:self.offset[document + 1] - 1]
        total = np.cumsum(self.length[sym])
        if i == (total[-1] if len(total) else 0):
            return self.end
        k = int(np.searchsorted(total, i, side="right"))
        i -= int(total[k - 1]) if k else 0
        x = int(sym[k])
        while x >= self.base:
            a, b = map(int, self.rules[x - self.base])
            x, i = (a, i) if i < self.length[a] else (b, i - int(self.length[a]))
        return x


FILE = ("part int, shard int, n_tokens long, base int, end_id int, doc_ids array<long>, offsets binary, rules binary, rule_lengths binary, symbols binary")


def _sharder(s: Settings, base: int):
    def pack(part: int, shard: int, docs: list, bodies: list[bytes]) -> pa.RecordBatch:
        mark = np.array([MARK], np.uint16).tobytes()
        seq = np.frombuffer(b"".join(x for b in bodies for x in (b, mark)), np.uint16)
        short, rules = repair(seq, base, s)
        length, _ = expansions(rules, base)
        offset = np.concatenate([[0], np.flatnonzero(short == MARK) + 1]).astype(np.uint32)
        row = {"part": part, "shard": shard, "n_tokens": len(seq), "base": base, "end_id": s.end, "doc_ids": docs, "offsets": offset.tobytes(),
               "rules": rules.tobytes(), "rule_lengths": length[base:].astype(np.uint32).tobytes(), "symbols": short.tobytes()}
        kinds = {"part": pa.int32(), "shard": pa.int32(), "n_tokens": pa.int64(), "base": pa.int32(), "end_id": pa.int32(), "doc_ids": pa.list_(pa.int64())}
        return pa.record_batch([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, docs, bodies, held = None, 0, [], [], 0
        for batch in batches:
            for p, d, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if docs and (p != part or held >= s.shard):
                    yield pack(part, shard, docs, bodies)
                    shard, docs, bodies, held = (shard + 1 if p == part else 0), [], [], 0
                part = p
                docs.append(d)
                bodies.append(ids.as_py())
                held += len(bodies[-1]) // 2 + 1
        if docs:
            yield pack(part, shard, docs, bodies)

    return run


def write_tokens(documents: DataFrame, path: str, settings: Settings) -> None:
    """Writes the ids of the texts of ``documents`` (position long, doc_id long, text) in ascending order of
    position to ``path``. Null and empty texts have the end id only; rows with a null position come first, rows of
    equal position in the order of doc_id; other columns are not read. An empty table writes no shard.

    Texts are encoded where they are read, so ids are shuffled and not texts. Ranges of positions come from
    quantiles, four per shuffle partition, so that partitions are even and no sampling job encodes twice."""
    from tokenizers import Tokenizer

    s = settings
    base = max(Tokenizer.from_file(s.tokenizer).get_vocab_size(with_added_tokens=True), s.end + 1)
    if base >= MARK:
        raise ValueError("ids must be below 65535")
    spark = documents.sparkSession
    docs = documents.select(F.col("position").cast("long").alias("position"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    bounds = docs.agg(F.percentile_approx("position", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    ids = docs.mapInArrow(_encoder(s, sorted(set(bounds))), "part int, position long, doc_id long, ids binary")
    rows = ids.repartition(parts, "part").sortWithinPartitions("part", "position", "doc_id")
    rows.mapInArrow(_sharder(s, base), FILE).write.option("compression", "zstd").parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at = Shard(row).whole()
            wide = ids.astype("<u4")
            yield pa.record_batch([
                pa.array([row["part"]] * (len(at) - 1), pa.int32()), pa.array([row["shard"]] * (len(at) - 1), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                pa.array(at[:-1]), pa.array(np.diff(at)), pa.array([zlib.crc32(wide[x:y]) for x, y in zip(at[:-1], at[1:])], pa.int64()),
            ], names=["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at = Shard(row).whole()
            yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), lists(ids.astype(np.int32), at, pa.int32())], names=["doc_id", "tokens"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tokens (end id included) of a token file."""
    return spark.read.schema(FILE).parquet(path).mapInArrow(_decoder, "doc_id long, tokens array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), from the decoded file. Starts of shards are one running sum over a row per shard and range."""
    file = spark.read.schema(FILE).parquet(path)
    order = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = file.select("part", "shard", "n_tokens")
    inside = sizes.withColumn("here", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).select("part", "shard", "here")
    ranges = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    base = inside.join(ranges, "part")
    rows = file.mapInArrow(_digests, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("here") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
