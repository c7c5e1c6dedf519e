import pandas as pd

from clipgrove.streaming.processors import Handshake, Ring


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def removeKey(self, k):
        del self[k]

    def updateValue(self, k, v):
        self[k] = v


class Rows(list):
    def exists(self):
        return bool(self)

    def get(self):
        return iter(self)

    def appendValue(self, v):
        self.append(v)


class Handle:
    def __init__(self):
        self.lists = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def getListState(self, *_):
        self.lists.append(Rows())
        return self.lists[-1]


def ring(*batches, window=100):
    p = Ring(window)
    p.init(Handle())
    out = []
    for b in batches:
        pdf = pd.DataFrame(b, columns=["kind", "segment", "seq", "time", "track", "key"])
        for f in p.handleInputRows((7,), iter([pdf]), None):
            out += [tuple(r) for r in f[["request_id", "seq", "track", "out_time"]].itertuples(index=False)]
    return sorted(out)


def test_audio_of_a_new_segment_leaves_the_old_one_on_air():
    rows = [(0, 1, 1, 10, "v", True), (0, 1, 2, 20, "a", None), (0, 2, 3, 30, "a", None), (1, None, 4, 30, None, None)]
    assert ring(rows) == [(4, 1, "v", 0), (4, 2, "a", 10)] == ring(rows[:3], rows[3:])
    later = [(0, 2, 5, 40, "v", True), (0, 1, 6, 45, "a", None), (1, None, 7, 50, None, None)]
    assert ring(rows, later)[2:] == [(7, 5, "v", 0)]


def test_rows_of_the_time_of_the_anchor_stay():
    rows = [(0, 1, 1, 0, "a", None), (0, 1, 2, 0, "v", True), (0, 1, 3, 50, "a", None), (0, 1, 4, 50, "v", True), (0, 1, 5, 150, "v", False), (1, None, 6, 150, None, None)]
    assert ring(rows) == [(6, 3, "a", 0), (6, 4, "v", 0), (6, 5, "v", 100)] == ring(rows[:1], rows[1:3], rows[3:])
    assert ring(rows[:4], [(1, None, 6, 60, None, None)]) == [(6, 1, "a", 0), (6, 2, "v", 0), (6, 3, "a", 50), (6, 4, "v", 50)]


def test_held_rows_are_packed_and_come_out_in_blocks():
    p, handle = Handshake(["v", "a"], None), Handle()
    p.init(handle)
    n = 70_000
    rows = pd.DataFrame({"seq": range(n), "track": ["v"] * n, "time": range(n), "key": [True] * n, "header": [False] * n})
    heads = pd.DataFrame({"seq": [-2], "track": ["v"], "time": [0], "key": [False], "header": [True]})
    assert sum(len(f) for f in p.handleInputRows((7,), iter([rows, heads]), None)) == 0
    assert [type(r[0]) for r in handle.lists[0]] == [bytes, bytes] and sum(len(r[0]) for r in handle.lists[0]) < 25 * n
    found = list(p.handleInputRows((7,), iter([heads.assign(track="a", seq=-1)]), None))
    assert sum(len(f) for f in found) == n and max(len(f) for f in found) <= 1 << 16 and not handle.lists[0]
