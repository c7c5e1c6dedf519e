import random

import numpy as np

from clipgrove.llm import decontaminate as D


def smith_waterman(a, b, s):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.other), h[i - 1][j] + s.gap, h[i][j - 1] + s.gap)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(5)
    s = D.Settings()
    items = [rng.integers(1, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(60)]
    texts = [rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    best, lo, hi = D.align(items, texts, s)
    for a, b, x, i, j in zip(items, texts, best, lo, hi):
        assert smith_waterman(a.tolist(), b.tolist(), s) == x == (smith_waterman(a.tolist(), b[i:j].tolist(), s) if x else 0)


def test_edited_copies(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [[word() for _ in range(rng.randrange(12, 40))] for _ in range(20)] + [["two", "words"]]
    s = D.Settings()
    docs, want = [], {}
    for i in range(300):
        text = [word() for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            k = rng.randrange(20)
            copy = [w if rng.random() > 0.15 else word() for w in items[k] if rng.random() > 0.05]
            text[10:10] = copy
        docs.append((i, " ".join(text)))
    docs.append((900, "A Two, WORDS."))
    docs.append((901, "the " * 500))
    bench = spark.createDataFrame([(k, " ".join(w).upper() + ".") for k, w in enumerate(items)] + [(50, None), (51, ""), (None, "a b c"), (3, " ".join(items[3]))], "item_id long, text string")
    for i, t in docs:
        words = t.lower().replace(",", "").replace(".", "").split()
        for k, w in enumerate(items):
            x = smith_waterman(w, words, s) / (s.match * len(w))
            if x >= s.least:
                want[i, k] = x
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as words", "'x' as item_id")
    got = {(r.doc_id, r.item_id): r.identity for r in D.contaminated(df, bench).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert (900, 20) in got and not any(i == 901 for i, _ in got)


def test_edited_copies_beside_exact_ones(spark):
    """Exact copies make the seeds that an edited copy lacks the rarer ones."""
    rng = random.Random(3)
    items = [[f"v{k}x{i}" for i in range(20 if k == 0 else rng.randrange(16, 60))] for k in range(60)]
    docs, want, s = [(k, " ".join(w)) for k, w in enumerate(items)], {(k, k): 1.0 for k in range(60)}, D.Settings()
    for k, w in enumerate(items):
        for n, share in enumerate((0.2, 0.25, 0.33)):
            # the words that replace others stand in many documents
            copy = [f"e{i % 7}" if (i % 5 == 4 if k == 0 else rng.random() < share) else x for i, x in enumerate(w)]
            i = 1000 + 10 * k + n
            docs.append((i, "before " + " ".join(copy) + " behind"))
            x = smith_waterman(w, copy, s) / (s.match * len(w))
            if x >= s.least and any(w[j:j + s.words] == copy[j:j + s.words] for j in range(len(w) - s.words + 1)):
                want[i, k] = x
    got = {(r.doc_id, r.item_id): r.identity for r in
           D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()}
    assert (1000, 0) in want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_bound_is_above_every_score():
    rng = np.random.default_rng(6)
    s = D.Settings()
    items = [rng.integers(1, 30, rng.integers(1, 15)).astype(np.uint64) for _ in range(200)]
    texts = [rng.integers(1, 30, rng.integers(1, 60)).astype(np.uint64) for _ in range(200)]
    top = D.at_most(items, texts, s)
    assert all(top[i] >= smith_waterman(a.tolist(), b.tolist(), s) for i, (a, b) in enumerate(zip(items, texts)))
    assert (top < s.least * s.match * np.array([len(x) for x in items])).any()


def test_odd_rows(spark, odd, empty, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert D.contaminated(odd, bench).count() == 0 and D.contaminated(empty, bench).count() == 0 and D.contaminated(odd, bench.limit(0)).count() == 0
    own = spark.createDataFrame([(1, "w x y z w x y z w x y z")], "item_id long, text string")
    assert [(r.doc_id, r.identity) for r in D.contaminated(odd, own).collect()] == [(6, 1.0)]


def test_phrases_that_many_items_share_make_no_pairs(spark):
    """Items and documents that only have a common phrase; and copies whose every word is in many items still found."""
    rng = random.Random(8)
    word = lambda p: f"{p}{rng.randrange(10**9)}"
    items = [(i, " ".join(["which", "of", "the", "following", *[word("q") for _ in range(12)]])) for i in range(300)]
    items += [(300 + i, "all of these words stand in more than eight items of the test") for i in range(12)]
    docs = [(i, " ".join([*[word("d") for _ in range(20)], "which", "of", "the", "following", *[word("d") for _ in range(20)]])) for i in range(2000)]
    docs += [(5000, f"x {items[7][1]} y"), (5001, f"u {items[300][1]} v")]
    docs, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    s = D.Settings()
    schema = "item_id long, words array<long>" + "".join(f", seeds{k} array<long>, n{k} int" for k in range(3))
    _, pairs = D.candidates(docs, tests.mapInArrow(D._item_words(s), schema), s)
    assert pairs.count() < 100
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, tests).collect()}
    assert got == {(5000, 7)} | {(5001, 300 + i) for i in range(12)}
