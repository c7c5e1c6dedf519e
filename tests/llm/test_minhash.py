import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa

from clipgrove.llm import minhash


def brute(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    seen, at = sorted(sets), {}
    for i in seen:
        c = Counter(j for g in sets[i] for j in at.get(g, ()))
        for g in sets[i]:
            at.setdefault(g, []).append(i)
        for j, k in c.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def got(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.Plan(**kw)).collect()}


def test_group_of_unlike_edits(spark):
    """One text with more and fewer edits: some members reach the class over others only, some not at all."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(f"z{rng.randrange(50)}" for _ in range(30))) for i in range(100)]
    want = brute(rows, 4)
    assert 1 < len({c for _, c, _ in want.values()}) < 240
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, words=4) == want
    assert got(df, words=4, block=200) == want  # many blocks per bucket


def test_odd_rows(spark, odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()], 5)
    assert got(odd.unionByName(odd.filter("doc_id < 5")).unionByName(odd.selectExpr("cast(null as long) as doc_id", "* except (doc_id)"))) == got(odd)
    assert got(empty) == {}


def test_words_of_one_pattern_are_not_copies(spark):
    """Words that collide under polynomial hashes modulo 2^64."""
    morse = lambda n, a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(n))
    rows = [(1, morse(1024, "a", "b")), (2, morse(1024, "b", "a")), (3, morse(4096, "a", "b")), (4, morse(4096, "b", "a")), (5, morse(1024, "A", "b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, words=4) == brute(rows, 4)


def block(members):
    """One block with all ``members`` (id, class, shingles) on both sides."""
    rows = [(1, 0, 0, side, i, k, sorted(g)) for side in (0, 1) for i, k, g in members]
    cols = [list(c) for c in zip(*rows)]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "x", "y", "side", "id", "k", "shingles"])


def joined(pairs, members):
    up = {k: k for _, k, _ in members}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    k = {i: k for i, k, _ in members}
    for a, b in pairs:
        up[max(root(k[a]), root(k[b]))] = min(root(k[a]), root(k[b]))
    return {i: root(k[i]) for i in k}


def test_links_of_a_block_equal_all_pairs():
    rng = random.Random(8)
    for percent in (50, 80, 100):
        for trial in range(30):
            pool = list(range(rng.choice((6, 20, 60))))
            members = [(i, rng.choice((i, i, i // 3)), set(rng.sample(pool, rng.randrange(1, min(12, len(pool)))))) for i in range(rng.randrange(2, 40))]
            want = [(a, b) for a, _, g in members for b, _, h in members if a < b and 100 * len(g & h) >= percent * len(g | h)]
            got = [r for batch in minhash._block_links(percent, tile=rng.choice((3, 1024)))(iter([block(members)])) for r in zip(*(c.to_pylist() for c in batch.columns))]
            assert set(got) <= set(want) and len(got) < len({k for _, k, _ in members})
            assert joined(got, members) == joined(want, members)


def test_short_members_with_a_common_line_take_little_memory():
    members = [(i, i, {0, i + 1}) for i in range(12_000)] + [(20_000, 20_000, {0, 1})]
    rows = block(members)
    tracemalloc.start()
    got = [batch.to_pylist() for batch in minhash._block_links(80)(iter([rows]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[{"a": 0, "b": 20_000}]] and peak < 200 << 20
