import random

import pytest

from clipgrove.llm import mixing


def weights(spark, d):
    return spark.createDataFrame(list(d.items()), "source string, weight int")


def test_blocks_stay_within_one_of_their_share(spark):
    sizes = {"a": 400, "b": 90, "c": 33, "d": 7}
    w = {"a": 7, "b": 5, "c": 2, "d": 1}
    rows = [(i, s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, weights(spark, w), block=2).collect()
    assert len(got) == len(rows) and len({(r.slot, r.offset) for r in got}) == len(rows)
    owner = {r.slot: r.source for r in got}
    assert sorted(owner) == list(range(len(owner)))
    assert all(r.release <= r.slot < r.due for r in got)
    # shares by hand: in each phase, weights over those that still have blocks
    blocks = {s: -(-n // 2) for s, n in sizes.items()}
    had, start, base = dict.fromkeys(w, 0), 0, dict.fromkeys(w, 0)
    live = {s for s in w}
    for slot in range(len(owner)):
        had[owner[slot]] += 1
        q = sum(w[s] for s in live)
        for s in live:
            assert abs(had[s] - base[s] - (slot + 1 - start) * w[s] / q) < 1
        done = {s for s in live if had[s] == blocks[s]}
        if done:
            live, start, base = live - done, slot + 1, dict(had)
    for s in w:
        ids = [r.doc_id for r in sorted((r for r in got if r.source == s), key=lambda r: (r.slot, r.offset))]
        assert ids == sorted(ids)


def test_odd_rows_and_limits(spark, odd, empty):
    got = mixing.mix(odd.unionByName(odd), weights(spark, {"a": 2, "": 3}), block=3).collect()
    assert len(got) == 2 * odd.count() and {r.source for r in got} == {"", "a", "b", "c"}
    assert mixing.mix(empty, weights(spark, {"a": 1})).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, weights(spark, {"a": 2_000_000}))


def slot_by_slot(sources):
    left, block, base, start, slot = [n for _, n in sources], [0] * len(sources), [0] * len(sources), 0, 0
    while any(left):
        q = sum(a for (a, _), n in zip(sources, left) if n)
        due, i = min((-(-(block[i] - base[i] + 1) * q // a), i) for i, (a, _) in enumerate(sources) if left[i] and (block[i] - base[i]) * q // a <= slot - start)
        yield i, block[i], slot, start + (block[i] - base[i]) * q // sources[i][0], start + due
        block[i], left[i], slot = block[i] + 1, left[i] - 1, slot + 1
        if not left[i]:
            base, start = list(block), slot


def test_heaps_equal_slot_by_slot():
    rng = random.Random(4)
    for _ in range(300):
        sources = [(rng.choice((1, 1, 2, 3, rng.randrange(1, 40))), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 25))]
        assert list(mixing.steps(sources)) == list(slot_by_slot(sources))


def test_any_number_of_sources(spark, monkeypatch):
    rng = random.Random(5)
    names = sorted(f"site{i}" for i in range(400))
    sizes, w = {s: rng.randrange(1, 9) for s in names}, {s: rng.randrange(1, 4) for s in names[::3]}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(x for s in names for x in [s] * sizes[s])], "doc_id long, source string")
    got = mixing.mix(docs, weights(spark, w), block=2).collect()
    assert len(got) == sum(sizes.values()) == len({(r.slot, r.offset) for r in got})
    want = {(names[i], *rest) for i, *rest in slot_by_slot([(w.get(s, 1), -(-sizes[s] // 2)) for s in names])}
    assert {(r.source, r.block, r.slot, r.release, r.due) for r in got} == want
    # both forms are one schedule
    some = docs.filter("source < 'site11'")
    few = mixing.mix(some, weights(spark, w), block=2)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    many = mixing.mix(some, weights(spark, w), block=2)
    assert few.columns == many.columns and few.dtypes == many.dtypes and sorted(few.collect()) == sorted(many.collect())
