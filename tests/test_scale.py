"""Work is spread over tasks and states, whatever the size of the tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelattice.sources import fixtures as fx

D = "/root/testdata/sf0.001"


def test_lattice_cells_are_made_in_many_tasks(spark):
    """One clip of six frames: its cells do not all come from one task."""
    cells = fx.wide_raster(spark, D).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in cells) == 6 * 48 * 32 and len(cells) > 1


class Value:
    ops = 0

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        Value.ops += 1
        return self.v

    def update(self, v):
        Value.ops += 1
        self.v = v


class Map(dict):
    def updateValue(self, k, v):
        Value.ops += 1
        self[k] = v

    def getValue(self, k):
        Value.ops += 1
        return self.get(k)

    def containsKey(self, k):
        return k in self

    def removeKey(self, k):
        Value.ops += 1
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """State of one group, in memory."""

    def __init__(self, processor):
        self.timers, self.processor = set(), processor
        processor.init(self)

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.add(t)

    def batch(self, key, rows, watermark):
        out = list(self.processor.handleInputRows(key, iter([rows]), None)) if len(rows) else []
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda _: watermark})()
        for t in [t for t in self.timers if t <= watermark]:
            self.timers.discard(t)
            out += self.processor.handleExpiredTimer(key, now, None)
        return out


def test_packed_streams_order_rows_as_single_keys_do(spark):
    """Random arrivals, repeats, gaps and late frames of several keys: a bucket publishes what the plain processor does for each key."""
    from framelattice.streaming import stateful as S

    class Plain(S.InOrder):
        columns, payload = ["v"], "v double"

        def advance(self, key, rows, fresh, late):
            return rows.assign(clip_id=key[0], fresh=[fresh] + [False] * (len(rows) - 1))

    class Packed(S.PackedInOrder):
        key, columns, block, held = "clip_id", ["v"], 4, 7

        def advance(self, rows, fresh, late):
            return {"v": rows["v"], "fresh": fresh}

    rng = np.random.default_rng(3)
    late = fresh = 0
    for _ in range(60):
        n = int(rng.integers(1, 60))
        f = rng.integers(-2, 30, n)
        d = pd.DataFrame({"clip_id": rng.integers(0, 4, n), "frame_no": f, "v": rng.random(n)})
        d["ts"] = pd.to_datetime((d["frame_no"] + rng.integers(0, 4, n)) * 10 + 1000, unit="ms")
        d = d.iloc[np.argsort(d["frame_no"] + rng.integers(0, 12, n), kind="stable")]
        one, many, a, b = Handle(Packed()), {k: Handle(Plain()) for k in range(4)}, [], []
        for part in [*np.array_split(np.arange(n), 6), np.arange(0)]:
            rows = d.iloc[part]
            wm = int(rows["ts"].max().value // 10**6 - 25) if len(rows) else 10**6 + 5
            a += one.batch((0,), rows, wm)
            for k, h in many.items():
                b += h.batch((k,), rows[rows["clip_id"] == k], wm)
        cols = ["clip_id", "frame_no", "v", "fresh", "late"]
        a, b = (pd.concat(x)[cols].sort_values(["clip_id", "frame_no"]).reset_index(drop=True).astype(float) for x in (a, b))
        pd.testing.assert_frame_equal(a, b)
        late, fresh = late + a["late"].sum(), fresh + a["fresh"].sum()
    assert late > 20 and fresh > 100


def test_gaps_between_all_frames_cost_no_state_call_each(spark):
    """20,000 frames of a clip, seven numbers apart, that all wait for the watermark: g03_stream_progress."""
    from framelattice.streaming import stateful as S

    f = np.random.default_rng(1).permutation(20000)
    d = pd.DataFrame({"clip_id": 3, "frame_no": f * 7, "ts": pd.to_datetime(f * 280, unit="ms"), "total_ms": 1.5, "total_frames": 20005})
    h, Value.ops = Handle(S.RunningProgress()), 0
    assert not [x for part in np.array_split(np.arange(20000), 4) for x in h.batch((0,), d.iloc[part], 0) if (x["frame_no"] > 0).any()]
    out = pd.concat(h.batch((0,), d.iloc[:0], 10**12)).sort_values("frame_no")
    assert Value.ops < 500 and (out["done"] == np.arange(2 if len(out) < 20000 else 1, 20001)).all()
    assert abs(out["elapsed_s"].iloc[-1] - 30.0) < 1e-9


def test_parts_of_many_frames_share_their_state(spark):
    """3,000 frames in parts, every seventh short: g04_partial_frames."""
    from framelattice.streaming import stateful as S

    n = 3000
    d = pd.DataFrame({"clip_id": 1, "frame_no": np.repeat(np.arange(n), 2), "t": np.repeat(np.arange(n), 2) / 10, "frame_bytes": 10})
    d["bytes"] = np.where((d.index % 2 == 1) & (d["frame_no"] % 7 == 3), 4, 5)
    h, Value.ops = Handle(S.WholeFrames(30.0)), 0
    out = [x for part in np.array_split(np.random.default_rng(2).permutation(2 * n), 3) for x in h.batch((1, 0), d.iloc[part], 0)]
    assert set(pd.concat(out)["state"]) == {"complete"}
    out = pd.concat(out + h.batch((1, 0), d.iloc[:0], 10**9))
    assert Value.ops < 50 and sorted(out["frame_no"]) == list(range(n))
    assert ((out["state"] == "partial") == (out["frame_no"] % 7 == 3)).all()
    again = pd.concat(h.batch((1, 0), d.iloc[:1], 10**9))
    assert list(again["state"]) == ["late"]


def test_stall_watch_packs_waiting_times(spark):
    """A day and a half of times in any order with one pause: g04_stall_watch."""
    from framelattice.streaming import stateful as S

    t = np.r_[np.arange(0, 40000, 2.0), np.arange(60000, 130000, 2.0)]
    d = pd.DataFrame({"t": np.random.default_rng(4).permutation(np.r_[t, t[:100]])})
    h, Value.ops = Handle(S.StallWatch(100.0)), 0
    assert not [x for part in np.array_split(np.arange(len(d)), 4) for x in h.batch((1,), d.iloc[part], 0)]
    out = pd.concat(h.batch((1,), d.iloc[:0], 61000000) + h.batch((1,), d.iloc[:0], 10**12))
    assert [(r.last_t, r.state) for r in out.itertuples()] == [(39998.0, "resumed"), (129998.0, "stalled")] and Value.ops < 100
    assert list(pd.concat(h.batch((1,), d.iloc[:3], 10**12))["state"]) == ["late"] * 3


def test_candidates_are_tried_by_arrays_over_a_frame():
    """One frame's sums for d12_motion_candidate_error: a null counts whole, a cell with one channel has no pair, rows come once a candidate."""
    import pyarrow as pa

    from framelattice.operators.calibration import FrameErrors

    kind = pa.list_(pa.struct([("slot", pa.int32()), ("value", pa.float64())]))
    v = [[{"slot": 1, "value": 1.0}, {"slot": 2, "value": 0.0}], [{"slot": 1, "value": None}, {"slot": 2, "value": 0.0}], [{"slot": 1, "value": 1.0}]]
    cells = pa.table({"clip_id": [5] * 3, "y": [0, 0, 1], "x": [0, 1, 1], "l": [10.0, 20.0, 30.0], "fwd": [True] * 3, "v": pa.array(v, kind)})
    plane = pa.table({"y": [0, 0, 0, 1, 1, 1], "x": [0, 1, 2, 0, 1, 2], "l": [10.0, 12.0, 14.0, 20.0, 22.0, 24.0]})
    out = FrameErrors(3, 2, 3, 2)(cells, plane).to_pandas().set_index(["x_slot", "y_slot", "ordinal"])
    assert len(out) == 2 * 60 and (out["n"] == 2).all()
    # pixels x 1, no flip, forward: cell (0, 0) reads 12 against 10, the null cell counts whole and has no motion
    one = out.loc[(1, 2, 17)]
    assert abs(one["residual"] - (2 / 255 / 0.35 + 1.0)) < 1e-12 and one["motion"] == 1.0
