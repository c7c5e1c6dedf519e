import random

import numpy as np

from clipgrove.operators import stateful as SF
from tests.conftest import rows


def plain(data, gap):
    last, out = {}, []
    for key, seq, t in sorted(data, key=lambda r: (r[0], r[1])):
        if key not in last or t - last[key] >= gap:
            last[key] = t
            out.append((key, seq))
    return sorted(out)


def test_throttle_over_many_spans_equals_one_walk(frame):
    rng = random.Random(4)
    data = []
    for key, scale in ((1, 3), (2, 40), (3, 400), (4, 0)):
        t = 0
        for seq in range(1 if scale == 0 else 1500):
            t += rng.randint(-scale // 3, scale)
            data.append((key, seq, t))
    df = frame("k bigint, seq bigint, time bigint", data)
    assert rows(SF.accepted_rows(df, ["k"], "time", "seq", 50, span_gaps=3)) == plain(data, 50)
    assert rows(SF.throttle(df, ["k"], "time", 50), "k", "seq") == plain(data, 50)


def test_a_span_is_read_row_by_row_and_keeps_one_gap():
    steps = SF._Steps(100)
    for t in range(20_000):
        steps.add(t)
        assert len(steps.open) <= 101
    assert len(steps.entries) == 101
    assert list(steps.rows())[0] == (0 - 100, 19_900)


def test_walks_of_extremes_meet():
    rng = np.random.default_rng(2)
    w, h = 1280 + rng.integers(0, 60, 5000), 720 + np.arange(5000) // 1500
    w[2000:4500] = 1290
    first = [0, 3, 4, 900, 2600, 4999]
    want = [([i] + SF._walk(w, h, (w[i], h[i]), i + 1, 16))[-1] for i in first]
    assert SF._last_hits(w, h, first, 16) == want
