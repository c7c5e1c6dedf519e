"""Runs against a plain search over all periods."""

import random

import numpy as np
import pytest

from clipgrove.llm.periodic import Rule, find_runs, runs_of, stretches
from clipgrove.llm.words import mix


def plain(w, rule):
    found = []
    for q in range(1, len(w) // rule.times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(rule.least, rule.times * q):
                found.append((s, i - s + q, q))
            i += 1
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found))


def words(rng):
    k = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 2)):
        base = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        at = rng.randint(0, len(w))
        w[at:at] = (base * 40)[:rng.randint(10, 90)]
    return w


@pytest.mark.parametrize("rule", [Rule(), Rule(8, 3), Rule(6, 4)])
def test_automaton_and_stretches_find_all_runs(rule):
    rng = random.Random(5)
    for _ in range(400):
        w = words(rng)
        want = plain(w, rule)
        assert runs_of(w, rule) == want
        cut = [(int(x) + s, n, q) for x, y in zip(*stretches(mix(np.array(w, np.uint64)), np.array([0, len(w)]), rule))
               for s, n, q in runs_of(w[int(x):int(y)], rule)]
        assert sorted(cut) == want


def test_whole_table(spark):
    rng = random.Random(9)
    docs = [" \n".join("wörd%d" % x for x in words(rng)) + rng.choice(["", " ", "\t"]) for _ in range(60)]
    docs += [None, "", " \n", "one", "A a " * 12 + "A a", "x " * 30000, docs[0]]
    df = spark.createDataFrame([(i if i else None, d, 1) for i, d in enumerate(docs)], "doc_id long, text string, runs int").repartition(3)
    got = {r["doc_id"]: r for r in find_runs(df).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        w = (d or "").split()
        want = plain(w, Rule()) if len(w) < 1000 else [(0, len(w), 1)]
        r = got[i or None]
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert [tuple(x) for x in r["runs"]] == want
        assert (r["n_words"], r["collapsed"]) == (len(w), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_odd_and_empty_tables(spark, odd, empty):
    assert find_runs(odd).count() == odd.count()
    assert find_runs(empty).count() == 0


def test_rules_without_a_proof_are_refused():
    with pytest.raises(ValueError):
        Rule(24, 2)
