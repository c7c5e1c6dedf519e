import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from clipgrove.llm import weighted as W


def jaccard(a, b):
    a, b = (Counter(w for w in re.split(r"[\x20\x09-\x0d]+", t.lower()) if w) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        out[i] = (t, t[:len(t) - len(t) // 2] + after[:len(t) // 2], after)
    return out


def test_collision_rate_is_generalised_jaccard(spark):
    a = " ".join(f"t{i}" for i in range(40) for _ in range(1 + i % 5))
    texts = {1: a, 2: " ".join(f"t{i}" for i in range(40) for _ in range(1 + (i + 1) % 4)), 3: " ".join(f"t{i}" for i in range(20, 60)), 4: a.upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sig = {r.doc_id: r.sig for r in W.signatures(df, ["doc_id"], 400).collect()}
    for x, y in ((1, 2), (1, 3), (2, 3)):
        assert abs(sum(p == q for p, q in zip(sig[x], sig[y])) / 400 - jaccard(texts[x], texts[y])) < 0.1
    assert sig[1] == sig[4]


def test_edits_hashes_and_odd_rows(spark, odd, empty, documents):
    for df in (odd, documents.limit(60), odd.limit(1)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        src = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"side": F.lit(1), "n": F.lit("x"), "to": F.lit(2)})
        got = {r.doc_id: r for r in W.with_edits(src).collect()}
        want = edited(rows)
        assert set(got) == set(want)
        for i, (text, new, after) in want.items():
            r = got[i]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert (r.fingerprint == "") == (not text.split()) and len(r.fingerprint) in (0, 6 * W.SAMPLES)
            assert abs(r.near_edited - (jaccard(text, new) if text.split() or new.split() else 1)) < 0.45
            assert r.near_next == 1 or text != after
    assert W.with_edits(empty).count() == 0
    twice = W.with_edits(odd.unionByName(odd))
    assert sorted(map(str, twice.collect())) == sorted(map(str, W.with_edits(odd).collect()))
