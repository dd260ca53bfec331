"""Per-clip and per-track state machines over frame streams.

Frames are processed strictly in order, whatever the order of arrival: rows that come early wait in the key's map state, repeats are dropped.
A lost frame is given up when the watermark passes the first frame that waits for it; a frame that comes after all is published on its own,
marked late. So a stream gives every row its batch counterpart gives, and the same results unless rows are later than allowed.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.consensus import RULES, vote
from ..operators.pairs import BINS, HIST_SHARE, MAD_SHARE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State processors need the RocksDB provider; it also keeps state off the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def watched(stream: DataFrame, late: str) -> DataFrame:
    """The stream with a watermark on its event time `ts`, which stays an ordinary column: timers follow the watermark, but Spark drops no
    row for being behind it."""
    return stream.withColumn("event", F.col("ts")).withWatermark("event", late).drop("event")


def _ms(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


class InOrder(StatefulProcessor):
    """Hands each key's rows to ``advance`` in frame order, once each, starting at frame ``first``; frames before it are late ones.

    Early rows wait, each with its event time. When the watermark passes the first of them, the frames missing before it are given up, and
    the next run starts afresh, as after a gap in a batch. A given-up frame that comes later goes to ``advance`` alone, fresh and late: it
    reads and writes no history. State is what arrives within the watermark's delay, and one entry a gap.
    """

    payload = ""  # DDL of the waiting columns
    columns: list[str] = []
    first = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next_frame = handle.getValueState("next_frame", "frame_no long, waiting long")
        self.waiting = handle.getMapState("waiting", "frame_no long", f"ms long, {self.payload}")
        self.gaps = handle.getMapState("gaps", "first long", "beyond long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def advance(self, key, rows: pd.DataFrame, fresh: bool, late: bool) -> pd.DataFrame:
        """Results of consecutive frames; fresh: they follow a gap, so nothing before them counts."""
        raise NotImplementedError

    def _run(self, key, rows: list, fresh: bool, late: bool = False) -> pd.DataFrame:
        out = self.advance(key, pd.DataFrame(rows, columns=["frame_no", *self.columns]), fresh, late)
        out["late"] = late
        return out

    def _given_up(self, frame: int) -> bool:
        """Whether a frame was given up; from now on it has come."""
        for (first,), (beyond,) in list(self.gaps.iterator()):
            if first <= frame < beyond:
                self.gaps.removeKey((first,))
                for a, b in ((first, frame), (frame + 1, beyond)):
                    if a < b:
                        self.gaps.updateValue((a,), (b,))
                return True
        return False

    def _take(self, key, early: dict, expected: int, passed: int | None) -> Iterator[pd.DataFrame]:
        """Runs from the expected frame on; frames before one whose time the watermark `passed` are given up. early: frame -> (ms, *values),
        or None for what is in the map state."""
        stored = {f for f, v in early.items() if v is None}
        fresh = False
        order = sorted(early, reverse=True)
        while early:
            run = []
            while expected in early:
                vals = early.pop(expected)
                if vals is None:
                    vals = self.waiting.getValue((expected,))
                    self.waiting.removeKey((expected,))
                    stored.discard(expected)
                run.append((expected, *vals[1:]))
                order.pop()
                expected += 1
            if run:
                yield self._run(key, run, fresh)
                fresh = False
            if not early:
                break
            first = order[-1]
            ms = (early[first] or self.waiting.getValue((first,)))[0]
            if passed is None or ms > passed:
                break
            self.gaps.updateValue((expected,), (first,))
            expected, fresh = first, True
        for f, vals in early.items():
            if f not in stored:
                self.waiting.updateValue((f,), vals)
        self.next_frame.update((expected, len(early)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if early:
            self.handle.registerTimer(self.waiting.getValue((order[-1],))[0] + 1)

    def _state(self) -> tuple[int, dict]:
        if not self.next_frame.exists():
            self.gaps.updateValue((-(1 << 62),), (self.first,))
            return self.first, {}
        expected, held = self.next_frame.get()
        # The map is only looked at while something waits in it.
        return expected, {f: None for (f,) in self.waiting.keys()} if held else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, early = self._state()
        for b in rows:
            b = b.loc[b["frame_no"].notna(), ["frame_no", "ts", *self.columns]]
            for f, ts, *vals in b.itertuples(index=False):
                if f >= expected:
                    early.setdefault(int(f), (_ms(ts), *vals))
                elif self._given_up(int(f)):
                    yield self._run(key, [(int(f), *vals)], True, True)
        yield from self._take(key, early, expected, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, early = self._state()
        yield from self._take(key, early, expected, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


def _pack(a: dict[str, np.ndarray]) -> bytes:
    return zlib.compress(pickle.dumps(a, 5), 1)


def _unpack(raw) -> dict[str, np.ndarray]:
    return pickle.loads(zlib.decompress(bytes(raw)))


def _joined(parts: list[dict]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _rows(a: dict, at) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in a.items()}


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)


class Parts:
    """Waiting rows as packed arrays, some entries a block: what a batch brings for a block is one write, and a block is one read."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.parts = handle.getMapState("waiting", "block long, part long", "packed binary")
        self.count = handle.getValueState("parts", "n long")

    def add(self, found: dict[int, dict]) -> None:
        n = self.count.get()[0] if self.count.exists() else 0
        for n, (block, a) in enumerate(found.items(), n + 1):
            self.parts.updateValue((int(block), n), (_pack(a),))
        if found:
            self.count.update((n,))

    def blocks(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for block, part in self.parts.keys():
            found.setdefault(block, []).append(part)
        return found

    def take(self, block: int, parts: list[int]) -> list[dict]:
        """A block's entries in order of arrival, which are no longer kept."""
        out = []
        for n in sorted(parts):
            out.append(_unpack(self.parts.getValue((block, n))[0]))
            self.parts.removeKey((block, n))
        return out


NONE = (1 << 63) - 1


class PackedInOrder(StatefulProcessor):
    """The rule of ``InOrder`` for numeric rows, for all keys of a bucket at once.

    Rows wait in packed blocks of frame numbers. Of a key's waiting rows, in frame order, those up to the first one go on that neither
    follows the frame before it nor is passed by the watermark; one that does not follow starts afresh. Blocks are taken one after the
    other, so what is in memory is one block, and what a batch costs is in proportion to its rows and the blocks they release. State is
    what arrives within the watermark's delay, a row a key, and one range a stretch of published frames, which tells late frames from
    repeats.
    """

    key = ""
    columns: list[str] = []
    first = 1
    block = 1 << 14
    held = 1 << 20  # rows of a batch that may be in memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("keys", "packed binary")
        self.waiting = Parts(handle)
        self.seen = handle.getMapState("seen", "block long", "packed binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def advance(self, rows: dict[str, np.ndarray], fresh: np.ndarray, late: bool) -> dict[str, np.ndarray]:
        """Results of rows sorted by key and frame; fresh: nothing before that row counts."""
        raise NotImplementedError

    def _run(self, bucket, rows: dict, fresh: np.ndarray, late: bool = False) -> pd.DataFrame:
        none = bucket[0] == -1  # the rows without a key
        out = {self.key: pd.array([None] * len(fresh), "Int64") if none else rows["key"], "frame_no": rows["frame_no"]}
        return pd.DataFrame({**out, **self.advance(rows, fresh, late), "late": late})

    def _keys(self) -> dict[str, np.ndarray]:
        """key; next frame; first waiting frame and its time; number of waiting rows."""
        if self.table.exists():
            return _unpack(self.table.get()[0])
        return {c: np.zeros(0, np.int64) for c in ("key", "next", "wait", "ms", "n")}

    def _with(self, t: dict, keys: np.ndarray) -> dict:
        new = np.setdiff1d(keys, t["key"])
        if not len(new):
            return t
        t = _joined([t, {"key": new, **{c: np.full(len(new), v) for c, v in (("next", self.first), ("wait", NONE), ("ms", NONE), ("n", 0))}}])
        return _rows(t, np.argsort(t["key"]))

    def _ranges(self, block: int) -> dict:
        if self.seen.containsKey((block,)):
            return _unpack(self.seen.getValue((block,))[0])
        return {c: np.zeros(0, np.int64) for c in ("key", "first", "beyond")}

    def _mark(self, block: int, key: np.ndarray, frame: np.ndarray) -> None:
        r = _joined([self._ranges(block), {"key": key, "first": frame, "beyond": frame + 1}])
        r = _rows(r, np.lexsort((r["first"], r["key"])))
        at = np.flatnonzero(np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["first"][1:] != r["beyond"][:-1])])
        self.seen.updateValue((block,), (_pack({"key": r["key"][at], "first": r["first"][at], "beyond": np.maximum.reduceat(r["beyond"], at)}),))

    def _late(self, bucket, rows: dict) -> Iterator[pd.DataFrame]:
        """Rows behind what their keys have published: those not published before go out alone."""
        for block, r in self._blocks(rows).items():
            r = _rows(r, np.lexsort((r["frame_no"], r["key"])))
            r = _rows(r, np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["frame_no"][1:] != r["frame_no"][:-1])])
            had = self._ranges(block)
            names = np.unique(np.r_[had["key"], r["key"]])
            place = lambda k, f: np.searchsorted(names, k) * (self.block + 1) + (f - block * self.block)
            at = np.searchsorted(place(had["key"], had["first"]), place(r["key"], r["frame_no"]), "right") - 1
            known = np.zeros(len(at), bool)
            if len(had["key"]):
                known = (at >= 0) & (had["key"][at] == r["key"]) & (r["frame_no"] < had["beyond"][at])
            r = _rows(r, ~known)
            if len(r["key"]):
                self._mark(block, r["key"], r["frame_no"])
                yield self._run(bucket, r, np.ones(len(r["key"]), bool), True)

    def _blocks(self, rows: dict) -> dict[int, dict]:
        b = rows["frame_no"] // self.block
        order = np.argsort(b, kind="stable")
        at = _starts(b[order])
        return {int(b[order[i]]): _rows(rows, order[i:j]) for i, j in zip(at, np.r_[at[1:], len(order)])}

    def _release(self, t: dict, live: np.ndarray, block: int, r: dict, passed: int) -> tuple[dict, np.ndarray, dict]:
        """The rows of a block that go on, which of them are fresh, and the rows that wait; keeps the table of keys."""
        r = _rows(r, np.lexsort((r["frame_no"], r["key"])))  # stable: of repeats the first to come is first
        repeat = np.r_[False, (r["key"][1:] == r["key"][:-1]) & (r["frame_no"][1:] == r["frame_no"][:-1])]
        np.subtract.at(t["n"], np.searchsorted(t["key"], r["key"][repeat]), 1)
        r = _rows(r, ~repeat)
        key, frame = r["key"], r["frame_no"]
        at = _starts(key)
        k = np.searchsorted(t["key"], key[at])
        size = np.diff(np.r_[at, len(key)])
        before = np.r_[0, frame[:-1]]
        before[at] = t["next"][k] - 1
        follows = frame == before + 1
        go = (follows | (r["ms"] <= passed)) & np.repeat(frame[at] <= t["wait"][k], size)
        stops = np.cumsum(~go)
        go &= stops - np.repeat(stops[at] - ~go[at], size) == 0
        gone = np.add.reduceat(go.astype(np.int64), at)
        first = frame[at] <= t["wait"][k]  # keys whose first waiting row is in this block
        rest = np.minimum(at + gone, len(key) - 1)
        left = gone < size
        t["next"][k] = np.where(gone > 0, frame[np.maximum(at + gone - 1, 0)] + 1, t["next"][k])
        t["n"][k] -= gone
        t["wait"][k] = np.where(first, np.where(left, frame[rest], NONE), t["wait"][k])
        t["ms"][k] = np.where(first, np.where(left, r["ms"][rest], NONE), t["ms"][k])
        live[k] &= ~left & (t["n"][k] > 0)
        return _rows(r, go), (~follows)[go], _rows(r, ~go)

    def _take(self, bucket, t: dict, new: dict[int, dict], passed: int) -> Iterator[pd.DataFrame]:
        live = (t["wait"] == t["next"]) | (t["ms"] <= passed)
        kept, parts = {}, self.waiting.blocks() if live.any() else {}
        for b in sorted(parts.keys() | new.keys()):
            carried = (live & (t["wait"] == NONE)).any()
            if not live.any() or not carried and b < t["wait"][live].min() // self.block:
                if b in new:
                    kept[b] = new[b]
                continue
            found = self.waiting.take(b, parts.get(b, [])) + ([new[b]] if b in new else [])
            rows, fresh, rest = self._release(t, live, b, _joined(found), passed)
            if len(rest["key"]):
                kept[b] = rest
            if len(rows["key"]):
                self._mark(b, rows["key"], rows["frame_no"])
                yield self._run(bucket, rows, fresh)
        self.waiting.add(kept)
        self.table.update((_pack(t),))
        for x in list(self.handle.listTimers()):
            self.handle.deleteTimer(x)
        if len(t["ms"]) and t["ms"].min() < NONE:
            self.handle.registerTimer(int(t["ms"].min()) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, new, held = self._keys(), [], 0
        for b in rows:
            b = b.loc[b["frame_no"].notna()]
            if not len(b):
                continue
            a = {"key": b[self.key].fillna(0).to_numpy(np.int64), "frame_no": b["frame_no"].to_numpy(np.int64),
                 "ms": b["ts"].to_numpy("datetime64[ms]").astype(np.int64), **{c: b[c].to_numpy(np.float64, na_value=np.nan) for c in self.columns}}
            t = self._with(t, a["key"])
            k = np.searchsorted(t["key"], a["key"])
            behind = a["frame_no"] < t["next"][k]
            yield from self._late(key, _rows(a, behind))
            a, k = _rows(a, ~behind), k[~behind]
            np.add.at(t["n"], k, 1)
            order = np.lexsort((a["frame_no"], k))
            at = order[_starts(k[order])]  # the first frame a key
            sooner = at[a["frame_no"][at] < t["wait"][k[at]]]
            t["wait"][k[sooner]], t["ms"][k[sooner]] = a["frame_no"][sooner], a["ms"][sooner]
            new.append(a)
            held += len(k)
            if held > self.held:
                self.waiting.add(self._blocks(_joined(new)))
                new, held = [], 0
        if len(t["key"]):
            yield from self._take(key, t, self._blocks(_joined(new)) if new else {}, -NONE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, self._keys(), {}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


def bucketed(stream: DataFrame, key: str, buckets: int):
    """The stream in buckets of keys; rows without a key are one of their own, as are rows without a frame, which only carry time."""
    b = F.when(F.col("frame_no").isNotNull(), F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))))
    return stream.withColumn("_bucket", b).groupBy("_bucket")


class SceneState(InOrder):
    """Cut score, cut flag and running scene number; state is the previous gray plane."""

    payload = "v binary"
    columns = ["v"]

    def __init__(self, threshold: float, first_score: float):
        self.threshold, self.first_score = min(0.95, max(0.05, threshold)), first_score

    def open(self, handle):
        self.previous = handle.getValueState("previous", "v binary, scene_id long")

    def advance(self, key, rows, fresh, late):
        prev, scene = self.previous.get() if self.previous.exists() else (None, 0)
        before = None if prev is None or fresh else np.frombuffer(prev, np.uint8)
        out = []
        for frame, raw in rows.itertuples(index=False):
            cur = np.frombuffer(raw, np.uint8)
            if before is None:
                score, cut = self.first_score, True
            elif len(before) != len(cur):
                score, cut = 1.0, True
            else:
                ha, hb = (np.bincount(a.astype(int) * BINS // 256, minlength=BINS) for a in (before, cur))
                hist = 0.5 * np.abs(ha - hb).sum() / len(cur)
                mad = np.abs(cur.astype(int) - before.astype(int)).mean() / 255.0
                score = float(np.clip(hist * HIST_SHARE + mad * MAD_SHARE, 0.0, 1.0))
                cut = score >= self.threshold
            scene += int(cut)
            out.append((key[0], frame, score, bool(cut), scene))
            before, prev = cur, raw
        found = pd.DataFrame(out, columns=["clip_id", "frame_no", "score", "cut", "scene_id"])
        if late:  # a scene of its own, without a number: later scenes have theirs already
            found["scene_id"] = pd.array([None] * len(found), "Int64")
        else:
            self.previous.update((prev, scene))
        return found


def pack_gray(planes: DataFrame) -> DataFrame:
    """frames(v array of 0..255) -> frames(v binary), the compact form kept in state."""
    byte = F.transform("v", lambda x: F.lpad(F.hex(x.cast("int")), 2, "0"))
    return planes.withColumn("v", F.unhex(F.array_join(byte, "")))


def stream_scene_state(frames: DataFrame, threshold: float, first_score: float = 1.0, late: str = "1 minute") -> DataFrame:
    """frames(clip_id, frame_no, ts, v binary gray plane) -> score, cut and scene number as frames arrive. A frame is given up when frames
    ``late`` after one behind it have come; a later one is published as a scene start without a number, marked late."""
    use_rocksdb(frames.sparkSession)
    return watched(frames, late).groupBy("clip_id").transformWithStateInPandas(
        SceneState(threshold, first_score), "clip_id long, frame_no long, score double, cut boolean, scene_id long, late boolean", "Append", "EventTime")


class TrackConsensus(PackedInOrder):
    """Trajectory consensus on tracks; state is the last three raw vectors of each."""

    key = "track_id"
    columns = ["vx", "vy", "confidence"]

    def __init__(self, mode: str):
        self.mode = mode

    def open(self, handle):
        self.past = handle.getValueState("past", "packed binary")

    def advance(self, rows, fresh, late):
        k = RULES[self.mode]
        depth = k["depth"]
        names = ["key", "frame_no", *self.columns]
        new = {c: rows[c] for c in names}
        # the first frame of the run a row belongs to; unknown where a run goes on
        new["start"] = np.where(fresh, rows["frame_no"], -NONE)
        at = _starts(rows["key"])
        new["start"][at] = np.where(fresh[at], new["start"][at], self.first)
        old = _unpack(self.past.get()[0]) if self.past.exists() and not late else _rows(new, slice(0, 0))
        mine = np.isin(old["key"], rows["key"])
        d = _joined([_rows(old, mine), new])
        given = np.r_[np.ones(mine.sum(), bool), fresh]
        order = np.lexsort((d["frame_no"], d["key"]))
        d, given = _rows(d, order), given[order]
        given[_starts(d["key"])] = True
        run = np.maximum.accumulate(np.where(given, np.arange(len(given)), 0))
        d["start"] = d["start"][run]
        is_new = (order >= mine.sum())
        at = np.flatnonzero(is_new)
        n = len(at)
        past, count, alive = [], np.zeros(n, int), np.ones(n, bool)
        for i in range(1, depth + 1):
            h = np.maximum(at - i, 0)
            # the first frame of a track, or after a gap, is a reset and not history
            alive = alive & (at >= i) & (d["key"][h] == d["key"][at]) & (d["frame_no"][at] - i > d["start"][at])
            alive = alive & (d["confidence"][h] >= k["conf"]) & (1.0 - d["confidence"][h] <= k["max_unc"])
            count += alive
            past.append(dict(vx=d["vx"][h], vy=d["vy"][h], conf=d["confidence"][h], vis=np.ones(n), unc=1.0 - d["confidence"][h]))
        cur = _rows(d, at)
        c = dict(vx=cur["vx"], vy=cur["vy"], conf=cur["confidence"], vis=np.ones(n), unc=1.0 - cur["confidence"], dis=np.zeros(n))
        dx, dy, b, _ = vote(self.mode, c, past, count)
        if not late:
            last = np.r_[_starts(d["key"])[1:], len(d["key"])]
            last = np.repeat(last, np.diff(np.r_[_starts(d["key"]), len(d["key"])]))
            tail = np.arange(len(d["key"])) >= last - depth
            self.past.update((_pack(_joined([_rows(old, ~mine), _rows(d, tail)])),))
        return {"history": count, "blend": b, "out_vx": cur["vx"] + dx, "out_vy": cur["vy"] + dy}


def stream_consensus(tracks: DataFrame, mode: str = "auto", late: str = "1 minute", buckets: int = 512) -> DataFrame:
    """tracks(track_id, frame_no, ts, vx, vy, confidence) as a stream; equals ``consensus_tracks``, with a reset after a frame given up. A
    frame is given up when frames ``late`` after one behind it have come; a later one is published without history, marked late. Tracks share
    their state by buckets."""
    use_rocksdb(tracks.sparkSession)
    return bucketed(watched(tracks, late), "track_id", buckets).transformWithStateInPandas(
        TrackConsensus(mode), "track_id long, frame_no long, history long, blend double, out_vx double, out_vy double, late boolean", "Append", "EventTime")


class RunningProgress(PackedInOrder):
    """Frames done, speed, fraction and time left of each clip; state is two sums a clip. A late frame counts from when it comes."""

    key = "clip_id"
    columns = ["total_ms", "total_frames"]
    first = 0

    def open(self, handle):
        self.sums = handle.getValueState("sums", "packed binary")

    def advance(self, rows, fresh, late):
        sums = _unpack(self.sums.get()[0]) if self.sums.exists() else {}
        count, elapsed = np.zeros(len(fresh), np.int64), np.zeros(len(fresh))
        at = _starts(rows["key"])
        for i, j in zip(at, np.r_[at[1:], len(fresh)]):
            done, ms = sums.get(int(rows["key"][i]), (0, 0.0))
            count[i:j] = done + np.arange(1, j - i + 1)
            elapsed[i:j] = np.cumsum(np.r_[ms, rows["total_ms"][i:j]])[1:]
            sums[int(rows["key"][i])] = (int(count[j - 1]), float(elapsed[j - 1]))
        self.sums.update((_pack(sums),))
        elapsed, n = elapsed / 1000.0, rows["total_frames"]
        with np.errstate(divide="ignore", invalid="ignore"):
            fps = np.where(elapsed > 0.001, count / elapsed, 0.0)
            eta = np.where(fps > 0.01, np.maximum(n - count, 0) / fps, 0.0)
            known = n > 0
            fraction, eta = (pd.array(v, "Float64") for v in (np.clip(count / n, 0, 1), eta))
            fraction[~known], eta[~known] = pd.NA, pd.NA
        return {"done": count, "elapsed_s": elapsed, "fps": fps, "fraction": fraction, "eta_s": eta}


def stream_progress(frames: DataFrame, late: str = "1 minute", buckets: int = 512) -> DataFrame:
    """frames(clip_id, frame_no, ts, total_ms, total_frames) -> progress and time left with every frame, as ``progress`` gives for tables.
    Clips share their state by buckets."""
    use_rocksdb(frames.sparkSession)
    return bucketed(watched(frames, late), "clip_id", buckets).transformWithStateInPandas(
        RunningProgress(), "clip_id long, frame_no long, done long, elapsed_s double, fps double, fraction double, eta_s double, late boolean", "Append", "EventTime")


class StallWatch(StatefulProcessor):
    """Alerts when a clip pauses longer than allowed. Times wait until the watermark has passed them, in packed blocks of a day, so they are
    seen in order whatever the order of arrival; one that comes later still is published as late."""

    block = 86400.0

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "t double, alerted boolean, first double")
        self.waiting = Parts(handle)

    def _state(self):
        """The last time seen in order, whether its pause was told, and a time not after the first waiting one."""
        return self.last.get() if self.last.exists() else (None, False, None)

    def _rest(self, last: float | None, alerted: bool, first: float | None) -> None:
        """Wakes up when the watermark passes the first waiting time, or the end of the pause allowed."""
        self.last.update((last, alerted, first))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = ([first] if first is not None else []) + ([last + self.seconds] if last is not None and not alerted else [])
        if ends:
            self.handle.registerTimer(int(min(ends) * 1000) + 1)

    def _blocks(self, times: np.ndarray) -> dict[int, dict]:
        times = np.unique(times)  # sorted
        b = np.floor(times / self.block).astype(np.int64)
        at = _starts(b)
        return {int(b[i]): {"t": times[i:j]} for i, j in zip(at, np.r_[at[1:], len(b)])}

    def handleInputRows(self, key, rows, timerValues):
        last, alerted, first = self._state()
        found = [np.zeros(0)]
        for b in rows:
            t = b.loc[b["t"].notna(), "t"].to_numpy(np.float64)
            behind = t <= last if last is not None else np.zeros(len(t), bool)
            if behind.any():
                yield pd.DataFrame({"clip_id": key[0], "last_t": last, "next_t": t[behind], "state": "late"})
            found.append(t[~behind])
        times = np.concatenate(found)
        if len(times):
            self.waiting.add(self._blocks(times))
            first = min(x for x in (first, float(times.min())) if x is not None)
        self._rest(last, alerted, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, alerted, first = self._state()
        now = timerValues.getCurrentWatermarkInMs() / 1000
        parts, first = self.waiting.blocks(), None
        for b in sorted(parts):
            if b * self.block > now:
                first = b * self.block
                break
            times = np.unique(_joined(self.waiting.take(b, parts[b]))["t"])
            due = times[times <= now]
            if len(due):
                before = np.r_[np.nan if last is None else last, due[:-1]]
                hit = due - before > self.seconds
                if hit.any():
                    yield pd.DataFrame({"clip_id": key[0], "last_t": before[hit], "next_t": due[hit], "state": "resumed"})
                last, alerted = float(due[-1]), False
            if len(due) < len(times):
                self.waiting.add(self._blocks(times[len(due):]))
                first = float(times[len(due)])
                break
        if last is not None and not alerted and now - last > self.seconds:
            yield pd.DataFrame([(key[0], last, None, "stalled")], columns=["clip_id", "last_t", "next_t", "state"]).astype({"next_t": "float64"})
            alerted = True
        self._rest(last, alerted, first)

    def close(self): ...


def stream_stall_watch(frames: DataFrame, seconds: float = 30.0, late: str = "1 minute") -> DataFrame:
    """frames(clip_id, t seconds) -> alerts by event time, on as many tasks as there are shuffle partitions: ``stalled`` when the watermark
    has gone more than ``seconds`` past a clip's last frame, ``resumed`` when a frame ends a pause, ``late`` for a frame behind what was
    already judged. Repeated times count once."""
    use_rocksdb(frames.sparkSession)
    return watched(frames.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long"))), late).groupBy("clip_id").transformWithStateInPandas(
        StallWatch(seconds), "clip_id long, last_t double, next_t double, state string", "Append", "EventTime")


class WholeFrames(StatefulProcessor):
    """Sums the bytes of each frame's parts, for a block of a clip's frames at once; a frame short of its size when the watermark has gone
    past its deadline is a failure."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle):
        self.handle = handle
        self.sums = handle.getValueState("sums", "packed binary")

    def _told(self, key, s: dict, at: np.ndarray, state) -> pd.DataFrame:
        frame = pd.array([None] * len(at), "Int64") if pd.isna(key[1]) else s["frame"][at]  # one frame without a number
        return pd.DataFrame({"clip_id": key[0], "frame_no": frame, "got": s["got"][at], "want": s["want"][at], "state": state})

    def _rest(self, s: dict) -> None:
        self.sums.update((_pack(s),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not s["told"].all():
            self.handle.registerTimer(int(self._ends(s)[~s["told"]].min()))

    def _ends(self, s: dict) -> np.ndarray:
        return np.floor((s["first"] + self.seconds) * 1000) + 1

    def handleInputRows(self, key, rows, timerValues):
        found = []
        for b in rows:
            b = b.loc[b["bytes"].notna()]
            if len(b):
                found.append(b.assign(frame_no=b["frame_no"].fillna(0).astype("int64")).groupby("frame_no").agg(
                    bytes=("bytes", "sum"), frame_bytes=("frame_bytes", "max"), t=("t", "min")))
        if not found:
            return
        new = pd.concat(found).groupby(level=0).agg({"bytes": "sum", "frame_bytes": "max", "t": "min"})
        frame = new.index.to_numpy()
        s = _unpack(self.sums.get()[0]) if self.sums.exists() else {
            "frame": frame[:0], "got": np.zeros(0, np.int64), "want": np.zeros(0, np.int64), "first": np.zeros(0), "told": np.zeros(0, bool)}
        more = np.setdiff1d(frame, s["frame"])
        m = len(more)
        s = _joined([s, {"frame": more, "got": np.zeros(m, np.int64), "want": np.zeros(m, np.int64), "first": np.full(m, np.inf), "told": np.zeros(m, bool)}])
        s = _rows(s, np.argsort(s["frame"]))
        at = np.searchsorted(s["frame"], frame)
        got = s["got"][at]
        s["got"][at] += new["bytes"].to_numpy(np.int64)
        s["want"][at] = np.maximum(s["want"][at], new["frame_bytes"].to_numpy(np.int64))
        s["first"][at] = np.fmin(s["first"][at], new["t"].to_numpy(np.float64))
        done = ~s["told"][at] & (s["got"][at] >= s["want"][at])
        late = s["told"][at] & (s["got"][at] > got)
        if (done | late).any():
            yield self._told(key, s, at[done | late], np.where(done, "complete", "late")[done | late])
        s["told"][at[done]] = True
        self._rest(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = _unpack(self.sums.get()[0])
        over = np.flatnonzero(~s["told"] & (self._ends(s) <= timerValues.getCurrentWatermarkInMs()))
        if len(over):
            yield self._told(key, s, over, "partial")
            s["told"][over] = True
        self._rest(s)

    def close(self): ...


def stream_whole_frames(parts: DataFrame, seconds: float = 30.0, late: str = "1 minute", block: int = 1 << 14) -> DataFrame:
    """parts(clip_id, frame_no, t seconds, bytes, frame_bytes) -> one row a frame: ``complete`` when its parts reach the frame's size,
    ``partial`` (a failure) when the watermark has gone ``seconds`` past its first part before; a part after the verdict adds a ``late``
    row. State is kept by blocks of ``block`` frame numbers of a clip."""
    use_rocksdb(parts.sparkSession)
    parts = parts.withColumns({"ts": F.timestamp_millis((F.col("t") * 1000).cast("long")), "_block": F.floor(F.col("frame_no") / F.lit(block))})
    return watched(parts, late).groupBy("clip_id", "_block").transformWithStateInPandas(
        WholeFrames(seconds), "clip_id long, frame_no long, got long, want long, state string", "Append", "EventTime")
