from clipgrove.operators import sampletable as ST
from tests.conftest import rows


def test_chunks_over_borders_of_blocks(frame):
    per = {1: [3, 9, 0, 2, 7], 2: [1], 3: [2, 2]}
    chunks = [(c, k + 1, 1000 * (k + 1)) for c, ns in per.items() for k in range(len(ns))]
    cmap = [(c, k + 1, n) for c, ns in per.items() for k, n in enumerate(ns)]
    sizes = [(c, s, s % 5 + 1) for c, ns in per.items() for s in range(sum(ns) + (c == 3))]  # the third disagrees
    want = []
    for c in (1, 2):
        s = 0
        for k, n in enumerate(per[c]):
            at = 1000 * (k + 1)
            for _ in range(n):
                want.append((c, s, k + 1, at, s % 5 + 1))
                at, s = at + s % 5 + 1, s + 1
    args = frame("clip bigint, chunk bigint, offset bigint", chunks), frame("clip bigint, first bigint, per_chunk bigint", cmap), frame("clip bigint, sample bigint, size bigint", sizes)
    for block in (4, 6, 1 << 20):
        assert rows(ST.samples_with_offsets(*args, block=block), "clip", "sample", "chunk", "offset", "size") == sorted(want)
