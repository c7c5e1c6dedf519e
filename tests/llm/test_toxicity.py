import math

import numpy as np

from clipgrove.llm import queries, toxicity as T


def plain_ftrl(rows, s):
    z, n, names = {}, {}, [("bias", 0.0)]

    def weight(k):
        l1 = 0.0 if k == "bias" else s.l1
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((s.beta + math.sqrt(n.get(k, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for f, y in rows:
            keys = [*f, "bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in keys:
                step = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / s.alpha
                z[k] = z.get(k, 0.0) + g - step * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_ftrl_equals_plain_loop():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 64, 9)), int(rng.integers(0, 2))) for _ in range(200)]
    s = T.Settings(bits=6, l1=0.5, alpha=0.3, epochs=2)
    want = plain_ftrl([(f.tolist(), y) for f, y in rows], s)
    bias, index, weight = T.ftrl(rows, s)
    assert math.isclose(bias, want.pop("bias"), abs_tol=1e-9)
    assert set(index.tolist()) == set(want) and all(math.isclose(w, want[i], abs_tol=1e-9) for i, w in zip(index.tolist(), weight))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    bad, good = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in bad) > 0.75 * len(bad) and sum(r.predicted for r in good) < 0.02 * len(good)
    order = sorted((r.score for r in good))
    assert np.mean(np.searchsorted(order, [r.score for r in bad])) > 0.95 * len(good)


def test_labels_decide_and_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(i, "you idiot, go" if i % 3 == 0 else "what a fine day") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (3, None), (3, 0)], "doc_id long, label int")
    model = T.fit(docs, labels, T.Settings(l1=0.1))
    score = {r.text: r.score for r in T.with_score(docs, model).collect()}
    assert score["you idiot, go"] > 0.5 > score["what a fine day"]
    rows = T.with_score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    none = T.fit(odd, labels.limit(0))
    assert none.rows == 0 and {r.score for r in T.with_score(odd, none).collect()} == {0.0}
    assert T.with_score(empty, model, "x").count() == 0 and T.fit(empty, labels).rows == 0
