"""Runs of words that repeat with a period, found with suffix automata and link-cut access.

The automaton of a word sequence has a tree of links; the path from the state of a prefix to the root holds all suffixes of
that prefix. When word i is appended, its path is accessed in a link-cut forest whose preferred paths are the stretches of
equal colour, the last end of their strings: each such path that the access meets, with longest string l and last end e, says
that the last l words before i occurred d = i - e words earlier, and never since. If l >= d these are squares of period d, and
as l is exact they are the whole stretch to the left with that period; the last i that shows it is its end. So a
run is one key (start, period) with its last end. The access then recolours the path. Its amortised cost is logarithmic.

Only words that can lie in a run get that far: every group of ``gram`` neighbouring words of a run occurs once more in it, so
stretches of words whose groups repeat within the stretch are cut out first, by sorting hashes; equal hashes of unlike words
only make a stretch longer. The automaton works on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clipgrove.llm.words import mix, text_slices, word_hashes, word_spans


@dataclass(frozen=True)
class Rule:
    """A run has at least ``least`` words and at least ``times`` (3 or more) periods."""

    least: int = 24
    times: int = 3

    def __post_init__(self):
        if self.times < 3 or self.least < 1:
            raise ValueError("times must be 3 or more, least 1 or more")

    @property
    def gram(self) -> int:
        """Groups of so many words repeat inside every run: max(least, 3 q) >= 2 q + gram - 1 for all periods q."""
        return (self.least + 5) // 3


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest string, link) of each state of the suffix automaton, and the state of each prefix. State 0 is the root."""
    length, link, out, ends, last = [0], [-1], [{}], [], 0
    for c in word:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        out.append({})
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                out.append(out[q].copy())
                link[q] = link[new] = twin
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = twin
                    p = link[p]
        ends.append(new)
        last = new
    return length, link, ends


class Access:
    """Link-cut forest over the links: ``met(v, i)`` accesses state v, gives (last end, longest string) of each preferred path
    from v to the root, deepest first, and recolours them all with i. The root itself is left out.

    A preferred path is a splay tree by depth; all its states have one colour, kept at the top of the tree."""

    def __init__(self, length: list[int], link: list[int]):
        self.length, self.up = length, [max(x, 0) for x in link]
        self.left, self.right, self.colour = [0] * len(link), [0] * len(link), [-1] * len(link)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                colour[x] = colour[g]
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            else:
                colour[x] = colour[p]
            self._rotate(x)
            p = up[x]

    def met(self, v: int, i: int) -> list[tuple[int, int]]:
        up, right, colour = self.up, self.right, self.colour
        out, below = [], 0
        while v:
            self._splay(v)
            c = colour[v]
            if c >= 0:
                out.append((c, self.length[v]))
            if right[v]:
                colour[right[v]] = c
            right[v] = below
            below = v
            v = up[v]
        colour[below] = i
        return out


def runs_of(word: list[int], rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence, by start, then period."""
    length, link, ends = automaton(word)
    forest, found, most = Access(length, link), {}, rule.times - 1
    for i, v in enumerate(ends):
        for e, l in forest.met(v, i):
            d = i - e
            if l >= most * d and l + d >= rule.least:
                found[i - d - l + 1, d] = i
    return sorted((start, end - start + 1, d) for (start, d), end in found.items())


def stretches(h: np.ndarray, before: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of the stretches that hold all runs, for word hashes ``h`` of texts that begin at ``before``."""
    k, least = rule.gram, max(1, rule.least - rule.gram + 1)
    none = np.zeros(0, np.int64)
    if len(h) < rule.least:
        return none, none
    rolled = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + h[i:len(h) - k + 1 + i])
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(text[:len(rolled)] == text[k - 1:])
    group = text[at]
    while len(at):
        key = mix(rolled[at] ^ mix(group.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        kept, of = at[again], group[again]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) > 1) | (of[1:] != of[:-1])
        part = np.cumsum(new) - 1
        long = (np.bincount(part, minlength=1) >= least)[part] if len(kept) else np.zeros(0, bool)
        kept, part = kept[long], part[long]
        if len(kept) == len(at):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            return at[first], at[np.append(first[1:], len(at)) - 1] + k
        at, group = kept, part
    return none, none


def _collapsed(data: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray, before: np.ndarray) -> pa.Array:
    """Kept words of each text with one space between them."""
    count = np.concatenate([[0], np.cumsum(kept)])[before]
    a, b = start[kept], end[kept]
    size = b - a + 1
    size[count[1:][np.diff(count) > 0] - 1] -= 1  # no space behind the last word of a text
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.append(data, np.uint8(32))[np.arange(total[-1]) - np.repeat(total[:-1] - a, size)]
    space = total[1:] - 1
    out[space[size > b - a]] = 32
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(total[count].astype(np.int64)), pa.py_buffer(out))


def _finder(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("text")):
                start, end, before = word_spans(data, offs)
                kept = np.ones(len(start), bool)
                found: list[tuple[int, int, int, int]] = []
                for x, y in zip(*stretches(word_hashes(data, start, end), before, rule)):
                    raw, number = data[start[x]:end[y - 1]].tobytes(), {}
                    shift = int(start[x])
                    word = [number.setdefault(raw[p - shift:q - shift], len(number)) for p, q in zip(start[x:y].tolist(), end[x:y].tolist())]
                    d = int(np.searchsorted(before, x, side="right")) - 1
                    for s, n, period in runs_of(word, rule):
                        kept[x + s + period:x + s + n] = False
                        found.append((d, int(x - before[d]) + s, n, period))
                found.sort(key=lambda r: (r[0], r[1], r[3]))
                table = np.array(found, np.int64).reshape(-1, 4)
                at = np.searchsorted(table[:, 0], np.arange(b - a + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
                yield pa.record_batch([
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(before)), pa.ListArray.from_arrays(pa.array(at), parts),
                    _collapsed(data, offs, start, end, kept, before).cast(pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period; in words from 0) and collapsed (the words that
    are in no run behind its first period, with one space between them) of every row of ``documents``.

    A run is a stretch with smallest period q and at least max(``least``, ``times`` * q) words that no neighbouring word extends.
    Words are runs of bytes other than ASCII white space and equal as they are written. Null, empty and blank texts have no
    words, no runs and an empty ``collapsed``. Every row has its own result, repeated rows and null ids too. Only doc_id and text
    are read; other columns may have any name. An empty table gives no rows. A row is worked on where it is read: nothing
    is shuffled, and the memory of a task grows with its longest periodic stretch (some hundred bytes a word)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_finder(rule), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
