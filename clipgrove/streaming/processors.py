"""Keyed state behind the streaming operators.

One processor holds one key (stream, source, day). A micro-batch delivers the new rows of a key;
they are put in arrival order and folded into a small state. Trigger size bounds what one call sees."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class Fold(StatefulProcessor):
    """Base: one ValueState with the columns ``schema``; ``step`` folds the rows of a batch to a frame, or an iterator of frames."""

    schema: StructType | str = ""
    order = ["seq"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        old = self.state.get() if self.state.exists() else None
        new, out = self.step(old, _rows(rows, self.order))
        self.state.update(tuple(int(v) if isinstance(v, np.integer) else v for v in new))
        if isinstance(out, pd.DataFrame):
            yield out
        else:
            yield from out

    def step(self, old, pdf: pd.DataFrame):
        raise NotImplementedError

    def close(self) -> None:
        pass


class SlotSelect(Fold):
    """Keeps rows that open a slot above all slots before."""

    schema = "base bigint, top bigint"

    def __init__(self, interval: int):
        self.interval = interval

    def step(self, old, pdf):
        base = old[0] if old else int(pdf["time"].iloc[0])
        d = pdf["time"].to_numpy() - base
        if self.interval <= 0:  # no slots: every row counts
            return (base, old[1] if old else -1), pdf.assign(slot=np.zeros(len(pdf), np.int64))
        slot = np.where(d <= 0, 0, (d + self.interval // 2) // self.interval)
        before = np.maximum.accumulate(np.r_[old[1] if old else -1, slot])[:-1]
        out = pdf.assign(slot=slot)[slot > before]
        return (base, int(max(before[-1], slot[-1]))), out


class Mix(StatefulProcessor):
    """Sums of a stream's samples per frame and channel, by the stream's own clock: a frame is done when the newest frame
    seen is ``lateness`` microseconds ahead of its end; rows of done frames are late. A row without a sample ends the
    stream and everything is done. The state is what is still open, a few hundred milliseconds."""

    def __init__(self, lateness: int, rate: int):
        self.lateness, self.rate = lateness, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "done bigint, top bigint, pending binary")

    def handleInputRows(self, key, rows, timerValues):
        done, top, raw = self.state.get() if self.state.exists() else (-(1 << 62), -(1 << 62), b"")
        open_ = np.frombuffer(bytes(raw), np.int64).reshape(-1, 3)
        ended = False
        for pdf in rows:
            ended |= bool(pdf["sample"].isna().any())
            pdf = pdf[pdf["sample"].notna() & (pdf["frame"] > done)]
            if len(pdf):
                new = np.stack([pdf["frame"].to_numpy(np.int64), pdf["ch"].to_numpy(np.int64), pdf["sample"].to_numpy(np.int64)], axis=1)
                keys, at = np.unique(np.concatenate([open_, new])[:, :2], axis=0, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at.ravel(), np.concatenate([open_, new])[:, 2])
                open_ = np.concatenate([keys, sums[:, None]], axis=1)
                top = max(top, int(new[:, 0].max()))
        end = (open_[:, 0] + 1) * 1_000_000 // self.rate
        ready = np.ones(len(open_), bool) if ended else end <= (top + 1) * 1_000_000 // self.rate - self.lateness
        out, rest = open_[ready], open_[~ready]
        done = max(done, top if ended else int(out[:, 0].max()) if len(out) else done)
        self.state.update((done, top, rest.tobytes()))
        yield pd.DataFrame({"stream_id": key[0], "frame": out[:, 0], "ch": out[:, 1].astype(np.int32), "sample": np.clip(out[:, 2], -32768, 32767).astype(np.int32)})

    def close(self) -> None:
        pass


class GapFill(Fold):
    """One row per slot: short gaps take the arriving row, stalls repeat the last one. Gaps are written in blocks."""

    schema = "slot bigint, seq bigint"
    block = 1 << 16

    def __init__(self, stall: int, fps: int):
        self.stall, self.fps = stall, fps

    def step(self, old, pdf):
        slot, seq = pdf["slot"].to_numpy(), pdf["seq"].to_numpy()
        last_slot = np.r_[old[0] if old else slot[0] - 1, slot[:-1]]
        last_seq = np.r_[old[1] if old else -1, seq[:-1]]
        n = slot - last_slot
        ends, stream = np.cumsum(n), pdf["stream_id"].to_numpy()

        def blocks():
            for first in range(0, int(ends[-1]), self.block):
                place = np.arange(first, min(first + self.block, int(ends[-1])))
                row = np.searchsorted(ends, place, side="right")
                at = last_slot[row] + 1 + place - (ends[row] - n[row])
                repeat = (slot[row] - 1 - last_slot[row] >= self.stall) & (at <= slot[row] - 2)
                yield pd.DataFrame({
                    "stream_id": stream[row], "slot": at, "source_seq": np.where(repeat, last_seq[row], seq[row]),
                    "filled": at != slot[row], "pts": at * 10_000_000 // self.fps})

        return (int(slot[-1]), int(seq[-1])), blocks()


class Timed(StatefulProcessor):
    """Base of processors that act when event time passes: one timer per key, set anew whenever the state changes. A timer runs when
    the watermark, which rows of all keys move, has passed its time; rows behind the watermark no longer come."""

    schema: StructType | str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def set_timer(self, at_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class TimedGapFill(Timed):
    """``GapFill`` that does not wait for the row behind a stall. Once the watermark is so far that any row to come ends a gap of
    ``stall`` slots, the slots that such a row leaves to the last one are written: all but the newest two."""

    schema = "slot bigint, seq bigint, at_us bigint, written bigint"
    block = GapFill.block

    def __init__(self, stall: int, fps: int, interval_us: int):
        self.stall, self.fps, self.interval = stall, fps, interval_us

    def frame(self, stream, slots: np.ndarray, seq, own) -> pd.DataFrame:
        n = len(slots)
        return pd.DataFrame({"stream_id": np.full(n, stream, np.int64), "slot": slots, "source_seq": np.broadcast_to(seq, n).astype(np.int64),
                             "filled": slots != own, "pts": slots * 10_000_000 // self.fps})

    def wait(self, slot: int, at_us: int, written: int) -> None:
        """Until one more slot can be written."""
        ahead = max(self.stall + 1, written + 3 - slot)
        self.set_timer(-(-(at_us + ahead * self.interval) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["seq"])
        slot, seq, at = pdf["slot"].to_numpy(np.int64), pdf["seq"].to_numpy(np.int64), pdf["us"].to_numpy(np.int64)
        old = self.state.get() if self.state.exists() else (int(slot[0]) - 1, -1, 0, int(slot[0]) - 1)
        last_slot, last_seq = np.r_[old[0], slot[:-1]], np.r_[old[1], seq[:-1]]
        first = np.r_[max(old[3], old[0]), slot[:-1]] + 1
        n = np.maximum(slot - first + 1, 0)
        ends = np.cumsum(n)
        self.state.update((int(slot[-1]), int(seq[-1]), int(at[-1]), max(int(slot[-1]), old[3])))
        self.wait(int(slot[-1]), int(at[-1]), int(slot[-1]))
        for start in range(0, int(ends[-1]), self.block):
            place = np.arange(start, min(start + self.block, int(ends[-1])))
            row = np.searchsorted(ends, place, side="right")
            here = first[row] + place - (ends[row] - n[row])
            repeat = (slot[row] - 1 - last_slot[row] >= self.stall) & (here <= slot[row] - 2)
            yield self.frame(key[0], here, np.where(repeat, last_seq[row], seq[row]), slot[row])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        slot, seq, at, written = self.state.get()
        now = slot + (timerValues.getCurrentWatermarkInMs() * 1000 - at) // self.interval
        upto = now - 2 if now - 1 - slot >= self.stall else written
        for start in range(written + 1, upto + 1, self.block):
            yield self.frame(key[0], np.arange(start, min(start + self.block, upto + 1)), seq, slot)
        written = max(written, upto)
        self.state.update((slot, seq, at, written))
        self.wait(slot, at, written)


class TimedAway(Timed):
    """Changes between away and back: away ``gap`` after the last activity, as soon as the watermark or a later activity shows that none came, and
    back at the next activity. The clock of a stream starts with its first row."""

    schema = "last_us bigint, away boolean"

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def frame(self, stream, at: list[int], away: list[bool]) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": np.full(len(at), stream, np.int64), "at": np.array(at, np.int64), "away": np.array(away, bool)})

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["us"])
        at, active = pdf["us"].to_numpy(np.int64), pdf["active"].to_numpy().astype(bool)
        last, away = self.state.get() if self.state.exists() else (int(at[0]), False)
        t = np.r_[last, at[active]]
        open_ = np.diff(t) > self.gap
        if away and len(open_):
            open_[0] = False  # told before
        left, back = t[:-1][open_] + self.gap, t[1:][open_]
        out = [(int(x), True) for x in left] + [(int(x), False) for x in back]
        if away and len(t) > 1:
            out.append((int(t[1]), False))
        out.sort()
        away = away and len(t) == 1
        self.state.update((int(t[-1]), away))
        if not away:
            self.set_timer(-(-(int(t[-1]) + self.gap) // 1000))
        yield self.frame(key[0], [x for x, _ in out], [a for _, a in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, away = self.state.get()
        self.state.update((last, True))
        yield self.frame(key[0], [] if away else [last + self.gap], [] if away else [True])


class Changes(Fold):
    """Rows whose value differs from the one before; nothing came before the first."""

    schema = "value string"

    def __init__(self, column: str):
        self.column = column

    def step(self, old, pdf):
        values = pdf[self.column].astype(object).where(pdf[self.column].notna(), None).tolist()
        before = [old[0] if old else None, *values[:-1]]
        return (values[-1],), pdf[[a != b for a, b in zip(values, before)]]


class Throttle(Fold):
    """First row, then every row ``gap`` or more after the last accepted one."""

    schema = "last bigint"

    def __init__(self, gap: int):
        self.gap = gap

    def step(self, old, pdf):
        last, keep = (old[0] if old else None), []
        for t in pdf["time"].tolist():
            ok = last is None or t - last >= self.gap
            keep.append(ok)
            last = t if ok else last
        return (last,), pdf[keep]


class RateLimit(Fold):
    """At most ``most`` rows per window; a window opens at the first row after ``window``."""

    schema = "opened bigint, sent bigint"

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most

    def step(self, old, pdf):
        opened, sent = old if old else (None, 0)
        keep = []
        for t in pdf["time"].tolist():
            if opened is None or t - opened > self.window:
                opened, sent = t, 0
            sent += 1
            keep.append(sent <= self.most)
        return (opened, sent), pdf[keep]


class Away(Fold):
    """Marks rows that come ``gap`` or more after the last activity."""

    schema = "last bigint"

    def __init__(self, gap: int):
        self.gap = gap

    def step(self, old, pdf):
        t = pdf["time"].to_numpy()
        active = pdf["active"].to_numpy().astype(bool)
        start = old[0] if old else int(t[0])
        last = np.maximum.accumulate(np.where(active, t, start))
        last = np.maximum(last, start)
        return (int(last[-1]),), pdf.assign(away=~active & (t - last >= self.gap))


class DayBudget(Fold):
    """Lines of a day while their bytes fit, then one notice."""

    schema = "used bigint, closed boolean"
    order = ["n"]

    def __init__(self, cap: int):
        self.cap = cap

    def step(self, old, pdf):
        used, closed = old if old else (0, False)
        size = pdf["line"].map(lambda s: len(s.encode()) + 1).to_numpy()
        total = used + np.cumsum(size)
        fits = (total <= self.cap) & (not closed)
        out = pdf[fits].assign(notice=False)
        if not closed and not fits.all():
            at = int(np.argmin(fits))
            note = pdf.iloc[[at]].assign(notice=True)
            note["line"] = note["day"] + f" 23:59:59.999 WARN  logs: day limit of {self.cap} bytes reached"
            out = pd.concat([out, note])
            closed = True
        return (int(total[-1]), closed), out


class Continuity(StatefulProcessor):
    """Places the segments of a recording one behind the other (shift, end, base); audio that comes
    before the first keyframe waits for the base."""

    def init(self, handle):
        self.state = handle.getValueState("state", "segment bigint, shift bigint, max_end bigint, pending boolean, base bigint")
        self.held = handle.getListState("held", "seq bigint, at bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["seq"])
        segment, shift, end, pending, base = self.state.get() if self.state.exists() else (None, 0, None, False, None)
        out, held = [], []
        for r in pdf.itertuples():
            if segment is not None and r.segment != segment:
                pending = end is not None
            segment, video = r.segment, r.track == "v"
            if pending:
                if not (video and r.key):
                    continue
                shift, pending = end - r.seg_time, False
            at = r.seg_time + shift
            end = at + r.dur if end is None else max(end, at + r.dur)
            if base is None:
                if video and not r.key:
                    continue
                if not video:
                    held.append((r.seq, at))
                    continue
                base = at
                waiting = [tuple(x) for x in self.held.get()] if self.held.exists() else []
                out += [(s, a - base) for s, a in [*waiting, *held] if a >= base]
                self.held.clear()
                held = []
            if at >= base:
                out.append((r.seq, at - base))
        if held:
            self.held.appendList(held)
        as_int = [None if v is None else int(v) for v in (segment, shift, end)]
        self.state.update((*as_int, pending, None if base is None else int(base)))
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": [int(s) for s, _ in out], "out_time": [int(a) for _, a in out]})

    def close(self):
        pass


class Ring(StatefulProcessor):
    """The last ``window`` of a capture segment from an anchor keyframe, for every segment that may still be on air. The segment on air is that of the
    newest video row; audio goes to the ring of its own segment. State is kept per GOP, so that whole GOPs are dropped and only the open
    one is rewritten; segments that are not on air go once they are silent for ``window``. Rows come in the order of time; requests come in
    the same stream (kind 1) and get a snapshot."""

    early = -(1 << 62)

    def __init__(self, window: int):
        self.window = window

    def init(self, handle):
        cols = "seq array<bigint>, time array<bigint>, track array<string>"
        self.gops = handle.getMapState("gops", "segment bigint, start bigint, seq bigint", cols)
        self.meta = handle.getValueState("meta", "segment bigint")

    @staticmethod
    def _snapshot(request: int, at: int, gops: list) -> pd.DataFrame:
        base = gops[0][0][1]
        t = np.concatenate([np.array(v[1], np.int64) for _, v in gops])
        keep = (t >= base) & (t <= at)
        return pd.DataFrame({"request_id": np.full(int(keep.sum()), request, np.int64), "seq": np.concatenate([np.array(v[0], np.int64) for _, v in gops])[keep],
                             "track": np.concatenate([np.array(v[2], object) for _, v in gops])[keep], "out_time": t[keep] - base})

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["time", "kind", "seq"])
        on_air = self.meta.get()[0] if self.meta.exists() else None
        rings: dict = {}  # segment -> GOPs (key, columns), rising
        early: dict = {}  # audio of the newest time ahead of a first keyframe, which may have that time
        for k, v in sorted((tuple(k), [list(x) for x in v]) for k, v in self.gops.iterator()):
            if k[1] == self.early:
                early[k[0]] = list(zip(*v))
            else:
                rings.setdefault(k[0], []).append((k, v))
        stored, changed = {k for ring in rings.values() for k, _ in ring} | {(s, self.early, 0) for s in early}, set()
        out, held = [], 0
        for kind, segment, seq, time, track, is_key in zip(*[pdf[c].tolist() for c in ("kind", "segment", "seq", "time", "track", "key")]):
            if kind == 1:
                if rings.get(on_air):
                    out.append(self._snapshot(seq, time, rings[on_air]))
                    held += len(out[-1])
                if held > 1 << 16:
                    yield self._frame(key, out)
                    out, held = [], 0
                continue
            segment = int(segment)
            ring = rings.setdefault(segment, [])
            if track == "v":
                if segment != on_air:
                    for old in [s for s, r in rings.items() if s != segment and r and r[-1][1][1][-1] <= time - self.window]:
                        del rings[old]
                on_air = segment
                if is_key:
                    ring.append(((segment, time, seq), [[], [], []]))
                    for s, t, name in early.pop(segment, ()):
                        if t == time:
                            for col, v in zip(ring[-1][1], (s, t, name)):
                                col.append(v)
                gone = 0  # all GOPs before the last keyframe outside the window go
                while gone + 1 < len(ring) and ring[gone + 1][0][1] <= time - self.window:
                    gone += 1
                if gone:  # but their rows of the time of the anchor
                    anchor = ring[gone][0][1]
                    late = [x for _, v in ring[:gone] if v[1][-1] >= anchor for x in zip(*v) if x[1] >= anchor]
                    for col, values in zip(ring[gone][1], zip(*late)):
                        col[:0] = values
                    if late:
                        changed.add(ring[gone][0])
                    del ring[:gone]
            if not ring:
                if track != "v":
                    early[segment] = [x for x in early.get(segment, ()) if x[1] == time] + [(seq, time, track)]
                continue
            for col, v in zip(ring[-1][1], (seq, time, track)):
                col.append(v)
            changed.add(ring[-1][0])
        live = {k: v for ring in rings.values() for k, v in ring} | {(s, self.early, 0): [list(c) for c in zip(*x)] for s, x in early.items() if x}
        changed |= {(s, self.early, 0) for s in early}
        for k in stored - set(live):
            self.gops.removeKey(k)
        for k, v in live.items():
            if k in changed or k not in stored:
                self.gops.updateValue(k, tuple(v))
        if on_air is not None:
            self.meta.update((int(on_air),))
        yield self._frame(key, out)

    @staticmethod
    def _frame(key, parts: list) -> pd.DataFrame:
        none = pd.DataFrame({"request_id": np.zeros(0, np.int64), "seq": np.zeros(0, np.int64), "track": np.zeros(0, object), "out_time": np.zeros(0, np.int64)})
        rows = pd.concat(parts, ignore_index=True) if parts else none
        return rows.assign(stream_id=np.full(len(rows), key[0], np.int64))[["stream_id", "request_id", "seq", "track", "out_time"]]

    def close(self):
        pass


class Handshake(StatefulProcessor):
    """Holds the rows of a stream until every expected track has sent its header, or ``timeout_ms``
    after the first row; then tracks without a header and rows before the first video keyframe go."""

    def __init__(self, expected: list[str], timeout_ms: int | None):
        self.expected, self.timeout_ms = expected, timeout_ms

    def init(self, handle):
        self.handle = handle
        # rows in packed blocks, so a long wait costs a few bytes per row and no object
        self.held = handle.getListState("held", "rows binary")
        self.state = handle.getValueState("state", "headers array<string>, released boolean, base bigint, tracks array<string>, keyed boolean")

    row = np.dtype([("seq", "<i8"), ("time", "<i8"), ("track", "<i4"), ("key", "?")])
    block = 1 << 16

    def _blocks(self) -> list[np.ndarray]:
        return [np.frombuffer(bytes(r[0]), self.row) for r in self.held.get()] if self.held.exists() else []

    def _release(self, key, headers, base, tracks, blocks):
        """The base and frames of the rows of headed tracks from the first keyframe on."""
        headed = np.array([t in headers for t in tracks], bool)
        video = np.array([t == "v" for t in tracks], bool)
        names = np.array(tracks, object)
        if base is None and "v" in headers:
            for rows in blocks:
                first = video[rows["track"]] & rows["key"]
                if first.any():
                    base = int(rows["time"][np.argmax(first)])
                    break

        def frames():
            for rows in blocks if base is not None else ():
                rows = rows[headed[rows["track"]] & (rows["time"] >= base)]
                for at in range(0, len(rows), self.block):
                    part = rows[at:at + self.block]
                    yield pd.DataFrame({"stream_id": np.full(len(part), key[0], np.int64), "seq": part["seq"].astype(np.int64), "track": names[part["track"]],
                                        "out_time": part["time"].astype(np.int64) - base})

        return base, frames()

    def _empty(self):
        return pd.DataFrame({"stream_id": np.zeros(0, np.int64), "seq": np.zeros(0, np.int64), "track": np.zeros(0, object), "out_time": np.zeros(0, np.int64)})

    def handleInputRows(self, key, rows, timerValues):
        headers, released, base, tracks, keyed = self.state.get() if self.state.exists() else ([], False, None, [], False)
        if not self.state.exists() and self.timeout_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        headers, tracks, parts, announced = list(headers or []), list(tracks or []), [], []
        for pdf in rows:
            head = pdf["header"].to_numpy(bool)
            announced += list(zip(pdf["seq"][head].tolist(), pdf["track"][head].tolist()))
            pdf = pdf[~head]
            tracks += [t for t in pdf["track"].unique().tolist() if t not in tracks]
            part = np.zeros(len(pdf), self.row)
            part["seq"], part["time"] = pdf["seq"].to_numpy(np.int64), pdf["time"].to_numpy(np.int64)
            part["track"] = pdf["track"].map({t: i for i, t in enumerate(tracks)}).to_numpy(np.int32) if len(pdf) else 0
            part["key"] = pdf["key"].to_numpy(bool)
            parts.append(part)
        headers += [t for _, t in sorted(announced)]
        fresh = np.concatenate(parts)
        del parts
        fresh = fresh[np.argsort(fresh["seq"], kind="stable")]
        video = np.array([t == "v" for t in tracks] or [False], bool)
        keyed = bool(keyed or (video[fresh["track"]] & fresh["key"]).any())
        # Once released the set of tracks is settled.
        if released or (set(self.expected) <= set(headers) and keyed):
            base, out = self._release(key, headers, base, tracks, [fresh] if released else [*self._blocks(), fresh])
            yield from out
            self.held.clear()
            self.state.update((headers, True, base, tracks, keyed))
        else:
            for at in range(0, len(fresh), self.block):
                self.held.appendValue((fresh[at:at + self.block].tobytes(),))
            self.state.update((headers, False, base, tracks, keyed))
        yield self._empty()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        headers, released, base, tracks, keyed = self.state.get() if self.state.exists() else ([], True, None, [], False)
        if not released and "v" in (headers or []) and keyed:
            base, out = self._release(key, list(headers), base, list(tracks), self._blocks())
            yield from out
            self.held.clear()
            self.state.update((list(headers), True, base, list(tracks), keyed))
        yield self._empty()

    def close(self):
        pass
