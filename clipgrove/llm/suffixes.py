"""Removal of repeated byte strings by suffix arrays over the places that can repeat.

Every window of ``length`` bytes belongs to the least hash of its ``gram``-byte strings, so equal windows belong to the same
hash wherever they lie. A run is a row of neighbouring windows of one hash. Only runs whose hash occurs in another run (or
twice in the run) can hold a repeated window; their bytes meet by hash, and there a suffix array is built in two
stages: suffixes smaller than their successors are sorted directly, the others are induced from them bucket by
bucket, and neighbours with a common prefix of ``length`` bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clipgrove.llm.words import SLICE_BYTES, mix, signed, text_slices


@dataclass(frozen=True)
class Settings:
    """``length`` of a string that counts, ``gram`` bytes per hash, ``shard``: window starts sorted together (a larger
    group is sorted alone)."""

    length: int = 200
    gram: int = 32
    shard: int = 1 << 17


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of an odd base modulo 2^64, and those of its inverse; kept for the slices to come. With
    them the hash of every string of a fixed length is a difference of prefix sums."""
    if not _powers or len(_powers[0][0]) < n:
        base, size = 0x9E3779B97F4A7C15, max(n, SLICE_BYTES + 1)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = [(made[0], made[1])]
    return _powers[0]


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``w`` neighbours: running values from both ends of blocks of ``w``."""
    if w == 1:
        return x
    f = np.minimum if least else np.maximum
    n = len(x)
    pad = np.full(-n % w, x[-1], x.dtype)
    b = np.concatenate([x, pad]).reshape(-1, w)
    head = f.accumulate(b, axis=1).ravel()
    tail = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(tail[:n - w + 1], head[w - 1:n])


def runs(data: np.ndarray, offs: np.ndarray, s: Settings, ask_twice: bool = True) -> tuple[np.ndarray, ...]:
    """(text, hash, first window start, last one, twice) of the runs of a slice; starts count within the slice. ``twice``: the least hash
    lies at two places of the run (false for all if not asked for)."""
    n, w = len(data), s.length - s.gram + 1
    none = np.zeros(0, np.int64)
    if n < s.length:
        return none, none.view(np.uint64), none, none, none.astype(bool)
    power, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    h = mix((prefix[s.gram:] - prefix[:-s.gram]) * inverse[:n - s.gram + 1]) | np.uint64(1)
    least = _sliding(h, w, True)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    good = text[:n - s.length + 1] == text[s.length - 1:]
    owner = text[:n - s.length + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    twice = np.zeros(len(first), bool)
    if ask_twice:
        # where the neighbouring window has a greater least hash, the run's own lies at the very end only
        value = least[first]
        lo, hi = first + w - 1, last.copy()
        span = np.arange(w)
        search = np.flatnonzero(least[np.maximum(first - 1, 0)] <= value)
        for i in range(0, len(search), 4096):
            r = search[i:i + 4096]
            lo[r] = first[r] + (h[first[r][:, None] + span] == value[r][:, None]).argmax(axis=1)
        search = np.flatnonzero(least[np.minimum(last + 1, len(least) - 1)] <= value)
        for i in range(0, len(search), 4096):
            r = search[i:i + 4096]
            hi[r] = last[r] + w - 1 - (h[last[r][:, None] + span[::-1]] == value[r][:, None]).argmax(axis=1)
        twice = lo != hi
    return owner[first], least[first], first, last, twice


def _anchors(s: Settings):
    """hash, doc_id, first start, whether twice, and a number of the place that copies of a text share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("text")):
                text, h, first, _, twice = runs(data, offs, s)
                at = first - offs[text]
                sums = np.array([int.from_bytes(hashlib.blake2b(data[x:y].tobytes(), digest_size=8).digest(), "little") for x, y in zip(offs[:-1], offs[1:])], np.uint64)
                place = mix(sums[text] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.record_batch([pa.array(signed(h.copy())), batch.column("doc_id").slice(a, b - a).take(pa.array(text)), pa.array(at.astype(np.int32)),
                                       pa.array(twice), pa.array(signed(place))], names=["h", "doc_id", "at", "twice", "place"])

    return run


def _contexts(s: Settings):
    """The bytes of the wanted runs: hash, doc_id, first start, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("text")):
                text, h, first, last, _ = runs(data, offs, s, False)
                wanted = batch.column("wanted").slice(a, b - a)
                flat = wanted.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(b - a), np.diff(np.frombuffer(wanted.buffers()[1], np.int32)[wanted.offset:wanted.offset + b - a + 1]))
                pick = np.isin(first, offs[row] + flat)
                text, h, first, last = text[pick], h[pick], first[pick], last[pick]
                yield pa.record_batch([pa.array(signed(h.copy())), batch.column("doc_id").slice(a, b - a).take(pa.array(text)), pa.array((first - offs[text]).astype(np.int32)),
                                       pa.array([data[x:y + s.length].tobytes() for x, y in zip(first, last)], pa.binary())], names=["h", "doc_id", "at", "bytes"])

    return run


# ---- suffix sorting


def pack(text: np.ndarray) -> np.ndarray:
    """The 7 symbols of 9 bits from every place on as one number; those behind the end of a string are 0."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    out, alive = padded[:n].copy(), padded[:n] > 0
    for k in range(1, 7):
        out <<= np.uint64(9)
        alive &= padded[k:n + k] > 0
        out |= padded[k:n + k] * alive
    return out


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, packed: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` positions in the order of their suffixes, right in the first ``depth`` symbols. ``text``: small
    integers, 0 ends a string (and the text). ``packed``: what ``pack`` makes of it, if at hand.

    Stage one sorts directly the suffixes smaller than their successors (type B) that are wanted or start a chain of
    larger ones (type A) to a wanted one. Stage two scans the buckets of first symbols upwards: the suffix before each entry, if
    of type A, is the next of its own bucket."""
    n = len(text)
    packed = pack(text) if packed is None else packed
    place = np.arange(n, dtype=np.int32)
    backward = lambda x: np.minimum.accumulate(x[::-1])[::-1]
    diff = np.sign(text[1:].astype(np.int32) - text[:-1]).astype(np.int8)
    # the sign of the next change, equal neighbours having the type of the one behind
    after = backward(np.where(diff != 0, place[:-1], np.int32(n)))
    small = np.ones(n, bool)
    small[:-1] = (diff[np.minimum(after, n - 2)] > 0) | (after == n)
    # a chain runs from a wanted type A suffix to the next type B one
    chain = backward(np.where(small, place, np.int32(n)))[wanted]
    cover = np.bincount(wanted, minlength=n + 1) - np.bincount(chain + 1, minlength=n + 1)
    need = np.cumsum(cover[:n]) > 0
    direct = np.flatnonzero(need & small).astype(np.int32)
    direct = direct[_direct(packed, direct, depth)]
    heads = text[direct]
    edge = np.searchsorted(heads, np.arange(int(text.max()) + 2))
    induced: list[list[np.ndarray]] = [[] for _ in range(len(edge) - 1)]
    out = []

    def spread(entries: np.ndarray, c: int) -> np.ndarray:
        """Sends the type A predecessors of the entries to their buckets; returns those of bucket ``c``."""
        p = entries[entries > 0] - 1
        p = p[need[p] & ~small[p]]
        if not len(p):
            return p
        v = text[p]
        order = np.argsort(v, kind="stable")
        p, v = p[order], v[order]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        own = p[:0]
        for part in np.split(p, cut):
            k = int(text[part[0]])
            if k == c:
                own = part
            else:
                induced[k].append(part)
        return own

    for c in range(len(edge) - 1):
        wave = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = spread(wave, c)
        part = direct[edge[c]:edge[c + 1]]
        if len(part):
            out.append(part)
            spread(part, c)
    order = np.concatenate(out) if out else direct[:0]
    asked = np.zeros(n, bool)
    asked[wanted] = True
    return order[asked[order]]


def _direct(packed: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``at`` by their first ``depth`` symbols, those behind the end of a string left out: 7 symbols
    at a time, and again only where the order is open. Groups whose members agree in these symbols are not sorted."""
    order = np.arange(len(at), dtype=np.int32)
    group = np.zeros(len(at), np.int32)  # open groups, in order of place
    places = np.arange(len(at), dtype=np.int32)
    for d in range(0, depth, 7):
        if not len(places):
            break
        who = order[places]
        # an open place has no end in the symbols before, so it lies inside the text
        key = packed[at[who] + d]
        differ = np.zeros(int(group[-1]) + 1, bool)
        differ[group[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
        mixed = np.flatnonzero(differ[group])
        if len(mixed):
            sub = mixed[np.lexsort((key[mixed], group[mixed]))]
            who[mixed], key[mixed] = who[sub], key[sub]
            order[places] = who
        same = (key[1:] == key[:-1]) & (group[1:] == group[:-1]) & (key[1:] & np.uint64(511) > 0)
        head = np.concatenate([[True], ~same])
        open_ = ~head | np.concatenate([~head[1:], [False]])
        group = np.cumsum(head, dtype=np.int32)[open_]
        places = places[open_]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, packed: np.ndarray | None = None) -> np.ndarray:
    """For every entry but the first: symbols in common with the entry before, up to ``depth``; 7 at a time as long as all are equal."""
    packed = pack(text) if packed is None else packed
    out = np.zeros(max(0, len(order) - 1), np.int64)
    left, (a, b) = np.arange(len(out)), (order[:-1], order[1:])
    for d in range(0, depth, 7):
        x, y = packed[a + d], packed[b + d]
        # bits above the first difference, or up to the end of both strings
        full = (x == y) & (x & np.uint64(511) > 0)
        rest = ~full
        u, v = x[rest], y[rest]
        equal, more = np.zeros(len(u), np.int64), np.ones(len(u), bool)
        for k in range(6, -1, -1):
            p = u >> np.uint64(9 * k) & np.uint64(511)
            more &= (p == (v >> np.uint64(9 * k) & np.uint64(511))) & (p > 0)
            equal += more
        out[left[rest]] = d + equal
        left, a, b = left[full], a[full], b[full]
        if not len(left):
            break
    out[left] = depth
    return np.minimum(out, depth)


def _hits(bodies: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first start, last start) of the rows of neighbouring windows that also start elsewhere in ``bodies``. Of more than 8
    shards of starts, a share by window hash is sorted at a time: equal windows have one hash."""
    size = np.array([len(b) for b in bodies], np.int32)
    base = (np.cumsum(size + 1) - size - 1).astype(np.int32)
    text = np.zeros(int(size.sum()) + len(bodies), np.uint16)
    inside = np.ones(len(text), bool)
    inside[base + size] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8)
    text[inside] += 1
    count = size - s.length + 1
    row = np.repeat(np.arange(len(bodies), dtype=np.int32), count)
    wanted = (np.arange(len(row), dtype=np.int32) - np.repeat(np.cumsum(count) - count, count) + base[row]).astype(np.int32)
    passes = -(-len(wanted) // (8 * s.shard))
    share = np.zeros(len(wanted), np.int64)
    if passes > 1:
        power, inverse = powers(len(text) + 1)
        prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(text.astype(np.uint64)) * power[:len(text)], out=prefix[1:])
        share = (mix((prefix[wanted + s.length] - prefix[wanted]) * inverse[wanted]) % np.uint64(passes)).astype(np.int64)
    hit = np.zeros(len(text), bool)
    packed = pack(text)
    for j in range(passes):
        order = suffix_order(text, wanted[share == j], s.length, packed)
        equal = common_prefixes(text, order, s.length, packed) >= s.length
        hit[order[1:][equal]] = True
        hit[order[:-1][equal]] = True
    w = np.flatnonzero(hit[wanted])
    first = np.concatenate([[True], (np.diff(w) > 1) | (np.diff(row[w]) > 0)]) if len(w) else np.zeros(0, bool)
    x = np.flatnonzero(first)
    y = np.append(x[1:], len(w)) - 1 if len(w) else x
    r = row[w[x]]
    return r, wanted[w[x]] - base[r], wanted[w[y]] - base[r]


def _repeats(s: Settings):
    def marked(rows: dict[bytes, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        """Equal runs are sorted once and are repeats as a whole."""
        bodies, places = list(rows), list(rows.values())
        body, first, last = _hits(bodies, s)
        once = [(d, at + f, at + t + s.length) for i, f, t in zip(body.tolist(), first.tolist(), last.tolist()) if len(places[i]) == 1 for d, at in places[i]]
        more = ((d, at, at + len(b)) for b, p in rows.items() if len(p) > 1 for d, at in p)
        found = chain(once, more)
        while part := list(islice(found, 1 << 16)):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part)], names=["doc_id", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = {}, 0, None
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024).to_pydict()
                for h, d, a, b in zip(part["h"], part["doc_id"], part["at"], part["bytes"]):
                    if held >= s.shard and h != now:
                        yield from marked(rows)
                        rows, held = {}, 0
                    now = h
                    if (p := rows.get(b)) is None:
                        rows[b] = p = []
                        held += len(b) - s.length + 1
                    p.append((d, a))
        if rows:
            yield from marked(rows)

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in text_slices(batch.column("text")):
            rows = []
            for i, spans in enumerate(batch.column("spans").slice(a, b - a).to_pylist()):
                body, n = data[offs[i]:offs[i + 1]], int(offs[i + 1] - offs[i])
                joined: list[list[int]] = []
                for x, y in sorted((p["from"], p["to"]) for p in spans or ()):
                    if joined and x <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], y)
                    else:
                        joined.append([x, y])
                keep, last = [], 0
                for x, y in joined:
                    keep.append(body[last:x])
                    last = y
                keep.append(body[last:])
                rows.append((n, sum(y - x for x, y in joined), joined, hashlib.sha256(b"".join(k.tobytes() for k in keep)).hexdigest()))
            at = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
            flat = np.array([x for r in rows for p in r[2] for x in p], np.int64).reshape(-1, 2)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["from", "to"])
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), pa.array([r[3] for r in rows])],
                                  names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_strings(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of from, to: the maximal removed runs of bytes), kept_sha256 for every document: each byte covered
    by a string of ``length`` bytes that also starts elsewhere, in any document, is removed.

    Null texts are empty; texts below ``length`` bytes keep everything. Rows with a null doc_id are dropped; doc_id is
    expected to be unique, of repeated ids the smallest text counts. Copies of a text are repeats as a whole, and one of
    them takes part in the search. An empty table gives no rows; only doc_id and text are read."""
    s = settings
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    dealt = docs.repartition(parts, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    content = F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").alias("n"))
    keys = docs.select("doc_id", content.alias("c")).select("doc_id", "c.sha", "c.n").filter(F.col("n") >= s.length)
    classes = keys.groupBy("sha", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).filter("rep <> other")
    copies = keys.join(classes, ["sha", "n"]).select("doc_id", "n", (F.col("doc_id") == F.col("rep")).alias("first")).distinct()
    found = docs.mapInArrow(_anchors(s), "h long, doc_id long, at int, twice boolean, place long")
    again = found.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("twice").alias("t")).filter("a <> b or t").select("h")
    wanted = found.select("h", "doc_id", "at").join(again, "h").groupBy("doc_id").agg(F.collect_set("at").alias("wanted"))  # at most one per window of the text
    wanted = wanted.join(copies.filter("not first").select("doc_id"), "doc_id", "left_anti")
    parts_ = dealt.join(wanted, "doc_id").mapInArrow(_contexts(s), "h long, doc_id long, at int, bytes binary")
    marks = parts_.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_repeats(s), "doc_id long, from long, to long")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("from"), F.col("n").cast("long").alias("to"))
    spans = marks.unionByName(whole).groupBy("doc_id").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    return dealt.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        _cutter, "doc_id long, n_bytes long, n_removed long, spans array<struct<from: long, to: long>>, kept_sha256 string")
