import hashlib
import random
from collections import Counter

import numpy as np

from clipgrove.llm import suffixes as S


def brute(rows, length):
    texts = {i: (t or "").encode() for i, t in rows}
    c = Counter(t[k:k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if c[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        edge = [k for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])]
        out[i] = (len(t), sum(gone), len(edge), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def got(df, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in S.repeated_strings(df, S.Settings(**kw)).collect()}


def test_two_stage_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        text = np.array([x for _ in range(rng.randint(1, 5)) for x in [*(rng.randint(1, rng.choice([2, 4])) for _ in range(rng.randint(1, 40))), 0]], np.uint16)
        depth = rng.choice([3, 8, 20])
        inside = [i for i in range(len(text)) if text[i]]
        wanted = np.array(sorted(rng.sample(inside, max(1, len(inside) * 2 // 3))))
        order = S.suffix_order(text, wanted, depth)
        suffix = lambda i: tuple(text[i:i + np.flatnonzero(text[i:] == 0)[0]])[:depth]
        keys = [suffix(i) for i in order]
        assert sorted(order) == sorted(wanted) and keys == sorted(keys)
        same = [next((k for k in range(depth) if k >= min(len(a), len(b)) or a[k] != b[k]), depth) for a, b in zip(keys, keys[1:])]
        assert S.common_prefixes(text, order, depth).tolist() == same


def test_passages_periods_and_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(12) for _ in range(5)] + ["ab" * 60, "x" * 90]
    rows = []
    for i in range(120):
        parts = [prose(rng.randint(0, 25)) for _ in range(4)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(4), s[a:a + rng.randint(10, len(s))])
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[7][1]) for i in range(3)] + [(300, None), (301, ""), (302, "short"), (303, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as h", "2 as at")
    for kw in ({"length": 24, "gram": 8}, {"length": 24, "gram": 8, "shard": 50}, {"length": 40, "gram": 40}):
        assert got(df, **kw) == brute(rows, kw["length"])


def test_odd_rows(odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()], 200)
    assert got(odd.unionByName(odd)) == got(odd)
    assert got(empty) == {}


def test_equal_windows_meet_by_one_hash_wherever_they_lie():
    rng = np.random.default_rng(5)
    s = S.Settings(40, 8)
    same = rng.integers(97, 123, 40, dtype=np.uint8)
    parts = [rng.integers(97, 123, n, dtype=np.uint8) for n in (13, 200, 31)]
    data = np.concatenate([parts[0], same, parts[1], same, parts[2]])
    offs = np.array([0, 13 + 40 + 100, len(data)])
    text, h, first, last, _ = S.runs(data, offs, s)
    owner = {}
    for x, a, b in zip(h.tolist(), first.tolist(), last.tolist()):
        owner |= {i: x for i in range(a, b + 1)}
    assert owner[13] == owner[13 + 40 + 200]
    assert len(S.powers(1 << 21)[0]) >= 1 << 21 and S.powers(8)[0][1] * S.powers(8)[1][1] == 1


def test_equal_suffixes_are_not_sorted_again(monkeypatch):
    """Copies of a passage agree in every round, so only rounds with a difference sort them."""
    rng = random.Random(5)
    passage = [rng.randint(1, 256) for _ in range(230)]
    text = np.array([x for i in range(300) for x in [*passage, 1 + i % 7, 0]], np.uint16)
    wanted = np.concatenate([np.arange(31) + 232 * i for i in range(300)])
    sorted_, lexsort = [], np.lexsort

    def counted(keys):
        sorted_.append(len(keys[0]))
        return lexsort(keys)

    monkeypatch.setattr(np, "lexsort", counted)
    order = S.suffix_order(text, wanted, 200)
    keys = [text[i:i + 200].tolist() for i in order]
    assert len(order) == 31 * 300 and keys == sorted(keys)
    assert sum(sorted_) <= 2 * len(wanted)
    same = [next((k for k in range(200) if a[k] != b[k]), 200) for a, b in zip(keys, keys[1:])]
    assert S.common_prefixes(text, order, 200).tolist() == same
