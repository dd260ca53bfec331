"""Ordered per-scene filters whose state is the previous output.

A cut drops all history, so a scene is the exact unit of work: plane rows are spread by
(clip, scene), sorted by frame and streamed through the filter with one frame of state. Memory is
one Arrow batch plus that state, however long the scene.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import KEYS, big, clamp, clamp01, hypot
from ..functions.colour import rgb_to_ycocg
from ..sources.fields import long_to_planes
from . import consensus as C
from .lattice import EDGE_WEIGHTS, _sum, neighbourhood, nine, warp_lookup

# Rows (frames) per Arrow batch of the scans: planes are large, so batches are short.
FRAMES_PER_BATCH = 8


# Fixed element types of packed planes; every other field is a 32-bit float.
PACKED = {c: np.uint8 for c in ("r", "g", "b", "a", "age")}


def _unpack(column, row: int, field: str) -> np.ndarray:
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(column[row].as_buffer(), dtype=PACKED.get(field, np.float32))
    return column[row].values.to_numpy(zero_copy_only=False)


def _pack(values: list[np.ndarray], field: str) -> pa.Array:
    dtype = PACKED.get(field, np.float32)
    return pa.array([np.ascontiguousarray(v, dtype=dtype).tobytes() for v in values], type=pa.binary())


def pack_planes(planes: DataFrame, fields: list[str]) -> DataFrame:
    """Array planes to the packed form: one binary per field and frame, colours as bytes.

    The storage layout for large frames: a packed plane is copied as a block wherever an array is
    copied element by element, and colour takes a quarter of the room.
    """
    rest = [c for c in planes.columns if c not in fields]
    types = dict(planes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(len(rest))]
            for i, f in enumerate(fields):
                c = b.column(len(rest) + i)
                cols.append(_pack([_unpack(c, r, f) for r in range(b.num_rows)], f))
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, *fields])

    ddl = ", ".join([f"{c} {types[c]}" for c in rest] + [f"{f} binary" for f in fields])
    return planes.select(*rest, *fields).mapInArrow(run, ddl)


def scene_planes(cells: DataFrame, fields: list[str], segments: DataFrame, dtype: str = "double") -> DataFrame:
    """One row per frame with its scene number, cut flag and row-major field arrays."""
    planes = long_to_planes(cells.select(*KEYS, "y", "x", *[F.col(f).cast(dtype).alias(f) for f in fields]), fields)
    return planes.join(segments.select(*KEYS, "scene_id", "cut"), list(KEYS))


def scan(planes: DataFrame, fields: list[str], make: Callable[[], Callable], arrays: list[str], scalars: list[str],
         dtype: str = "double") -> DataFrame:
    """Runs a stateful step over every scene in frame order.

    Fields may be arrays or packed planes; dtype is the element type published (double, float) or
    ``packed``.

    make() returns a fresh step for a scene; step(cut, {field: array}) returns a dict with the
    ``arrays`` and ``scalars`` to publish. Frame order is checked on the way.
    """
    d = planes.select("clip_id", "scene_id", "frame_no", "cut", *fields)
    d = d.repartition("clip_id", "scene_id").sortWithinPartitions("clip_id", "scene_id", "frame_no")
    schema = ("clip_id long, scene_id long, frame_no long, " + ", ".join(
        [f"{a} binary" if dtype == "packed" else f"{a} array<{dtype}>" for a in arrays] + [f"{s} double" for s in scalars]))

    np_type = np.float32 if dtype == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, last, step = None, None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, FRAMES_PER_BATCH):
                b = whole.slice(lo, FRAMES_PER_BATCH)
                ids = [b.column(i).to_pylist() for i in range(4)]
                lists = [b.column(4 + i) for i in range(len(fields))]
                out_a: list[list[np.ndarray]] = [[] for _ in arrays]
                out_s: list[list[float]] = [[] for _ in scalars]
                for r in range(b.num_rows):
                    key, frame = (ids[0][r], ids[1][r]), ids[2][r]
                    if key != scene:
                        scene, last, step = key, None, make()
                    elif frame <= last:
                        raise RuntimeError(f"frames of scene {key} out of order: {frame} after {last}")
                    last = frame
                    planes_in = {f: _unpack(lists[i], r, f) for i, f in enumerate(fields)}
                    res = step(bool(ids[3][r]), planes_in)
                    for i, a in enumerate(arrays):
                        out_a[i].append(res[a] if dtype == "packed" else np.ascontiguousarray(res[a], dtype=np_type).ravel())
                    for i, s in enumerate(scalars):
                        out_s[i].append(float(res[s]))
                cols = [b.column(i) for i in range(3)]
                for a, vals in zip(arrays, out_a):
                    if dtype == "packed":
                        cols.append(_pack(vals, a))
                        continue
                    offs = np.zeros(len(vals) + 1, dtype=np.int32)
                    np.cumsum([len(v) for v in vals], out=offs[1:])
                    cols.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(vals))))
                cols += [pa.array(v, type=pa.float64()) for v in out_s]
                yield pa.RecordBatch.from_arrays(cols, names=["clip_id", "scene_id", "frame_no", *arrays, *scalars])

    return d.mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------
# lookups on planes


def _grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices((h, w), dtype=np.float64)
    return y, x


def bilinear(planes: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Values of equally sized planes at (x, y) and whether each position is inside."""
    h, w = planes[0].shape
    ok = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    cx, cy = np.where(ok, x, 0), np.where(ok, y, 0)
    x0, y0 = cx.astype(np.int32), cy.astype(np.int32)
    tx, ty = cx - x0, cy - y0
    i = y0 * w + x0
    r = (x0 < w - 1).astype(np.int32)
    d = np.where(y0 < h - 1, w, 0).astype(np.int32)
    ir, id_ = i + r, i + d
    idr = id_ + r
    out = []
    for p in planes:
        f = p.ravel()
        a, b, c, e = (f.take(k, mode="clip") for k in (i, ir, id_, idr))
        b -= a
        b *= tx
        b += a
        e -= c
        e *= tx
        e += c
        e -= b
        e *= ty
        e += b
        out.append(e)
    return out, ok


def _round8(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v + v.dtype.type(0.5)), 0, 255)


# ---------------------------------------------------------------------------------------------
# depth and output stabilisers


def stabilize_depth(planes: DataFrame, width: int, height: int, history_weight: float = 0.20, reject: float = 0.08) -> DataFrame:
    """Depth blended with the motion-compensated previous *stabilised* depth.

    planes(clip_id, scene_id, frame_no, cut, d, vx, vy, confidence).
    """
    weight = min(0.8, max(0.0, history_weight))

    def make():
        state: dict = {}

        def step(cut, p):
            d, vx, vy, c = (p[k].reshape(height, width).astype(np.float64) for k in ("d", "vx", "vy", "confidence"))
            out = d
            if not cut and "d" in state:
                y, x = _grid(height, width)
                (prev,), ok = bilinear([state["d"]], x + vx, y + vy)
                prev = np.where(ok, prev, d)
                w = np.where((c >= 0.25) & (np.abs(d - prev) <= reject), weight * c, 0.0)
                out = d * (1.0 - w) + prev * w
            state["d"] = out
            return {"d": out}

        return step

    return scan(planes, ["d", "vx", "vy", "confidence"], make, ["d"], [])


def stabilize_output(planes: DataFrame, width: int, height: int, history_weight: float = 0.14, reject: float = 0.12) -> DataFrame:
    """Colour blended with the motion-compensated previous *stabilised* output; alpha is not touched.

    planes(..., r, g, b, vx, vy, confidence). Outside the image history is black, as it is there.
    """
    weight = min(0.8, max(0.0, history_weight))

    def make():
        state: dict = {}

        def step(cut, p):
            rgb = [p[k].reshape(height, width).astype(np.float64) for k in "rgb"]
            out = rgb
            if not cut and "rgb" in state:
                vx, vy, c = (p[k].reshape(height, width).astype(np.float64) for k in ("vx", "vy", "confidence"))
                y, x = _grid(height, width)
                prev, ok = bilinear(state["rgb"], x + vx, y + vy)
                prev = [np.where(ok, q, 0.0) for q in prev]
                worst = np.max([np.abs(a - b) for a, b in zip(rgb, prev)], axis=0) / 255.0
                use = (c >= 0.35) & (worst <= reject)
                w = weight * c
                out = [np.where(use, np.clip(np.floor(a * (1.0 - w) + b * w + 0.5), 0, 255), a) for a, b in zip(rgb, prev)]
            state["rgb"] = out
            return dict(zip("rgb", out))

        return step

    return scan(planes, ["r", "g", "b", "vx", "vy", "confidence"], make, ["r", "g", "b"], [])


def stabilize_depth_raw(depth: DataFrame, flow: DataFrame, width: int, height: int, history_weight: float = 0.20,
                        reject: float = 0.08, segments: DataFrame | None = None) -> DataFrame:
    """The same rule against the previous *raw* depth: no recurrence, so one warp and no scan."""
    j = flow.select(*KEYS, "y", "x", "vx", "vy", "confidence").join(depth.select(*KEYS, "y", "x", "d"), [*KEYS, "y", "x"])
    s = warp_lookup(j, depth, {"d": "_p"}, width, height, "reject")
    prev = F.coalesce("_p", "d")
    ok = (F.col("confidence") >= 0.25) & (F.abs(F.col("d") - prev) <= reject)
    w = F.when(ok, history_weight * F.col("confidence")).otherwise(0.0)
    return _unless_cut(s.withColumn("out", F.col("d") * (1.0 - w) + prev * w), segments, {"out": "d"}).select(
        *KEYS, "y", "x", F.col("out").alias("d"))


def stabilize_output_raw(px: DataFrame, flow: DataFrame, width: int, height: int, history_weight: float = 0.14,
                         reject: float = 0.12, segments: DataFrame | None = None) -> DataFrame:
    j = flow.select(*KEYS, "y", "x", "vx", "vy", "confidence").join(px.select(*KEYS, "y", "x", "r", "g", "b"), [*KEYS, "y", "x"])
    first = F.min("frame_no").over(W.partitionBy("clip_id"))
    s = warp_lookup(j.withColumn("_first", first), px, {c: f"_{c}" for c in "rgb"}, width, height, "reject")
    prev = {c: F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in "rgb"}
    worst = F.greatest(*[F.abs(F.col(c) - prev[c]) for c in "rgb"]) / 255.0
    ok = (F.col("confidence") >= 0.35) & (worst <= reject) & (F.col("frame_no") > F.col("_first"))
    w = history_weight * F.col("confidence")
    s = s.withColumns({f"_o{c}": F.when(ok, clamp(F.round(F.col(c) * (1.0 - w) + prev[c] * w), 0.0, 255.0)).otherwise(F.col(c)) for c in "rgb"})
    return _unless_cut(s, segments, {f"_o{c}": c for c in "rgb"}).select(*KEYS, "y", "x", *[big(f"_o{c}").alias(c) for c in "rgb"])


def _unless_cut(d: DataFrame, segments: DataFrame | None, fields: dict[str, str]) -> DataFrame:
    if segments is None:
        return d
    j = d.join(segments.select(*KEYS, "cut"), list(KEYS), "left")
    return j.withColumns({o: F.when(F.coalesce(F.col("cut"), F.lit(False)), F.col(i)).otherwise(F.col(o)) for o, i in fields.items()})


# ---------------------------------------------------------------------------------------------
# denoiser


@dataclass(frozen=True)
class Denoise:
    full: bool = True
    strength: float = 0.72
    history: float = 0.76
    spatial: float = 0.22
    detail: float = 0.86
    max_age: int = 24
    luma_reject: float = 0.14
    chroma_reject: float = 0.18
    expansion: float = 0.025

    def clamped(self) -> Denoise:
        fit = lambda v, lo, hi: min(hi, max(lo, v))
        return Denoise(self.full, fit(self.strength, 0.0, 1.0), fit(self.history, 0.0, 0.98), fit(self.spatial, 0.0, 1.0),
                       fit(self.detail, 0.0, 1.0), fit(self.max_age, 2, 64), fit(self.luma_reject, 0.02, 0.5),
                       fit(self.chroma_reject, 0.02, 0.5), fit(self.expansion, 0.0, 0.15))


def _smoothstep(v):
    v = np.clip(v, 0, 1)
    return v * v * (3 - 2 * v)


def _denoise_rows(k: Denoise, pad: np.ndarray, y0: int, y1: int, hist, age, flow):
    """Rows y0..y1 of one frame. pad: (3, H+2, W+2) edge-padded 0..255 colour planes.

    Everything is computed in the element type of ``pad``; ``f32`` turns constants into it.
    """
    f32 = pad.dtype.type
    rows = pad[:, y0:y1 + 2]
    w = pad.shape[2] - 2
    n = y1 - y0
    r, g, b = rows
    yy = (f32(0.25) * r + f32(0.5) * g + f32(0.25) * b) / f32(255)
    co = (f32(0.5) * r - f32(0.5) * b) / f32(255)
    cg = (f32(-0.25) * r + f32(0.5) * g - f32(0.25) * b) / f32(255)
    win = lambda a, dy, dx: a[1 + dy:1 + dy + n, 1 + dx:1 + dx + w]
    offs = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    centre = [win(a, 0, 0) for a in (yy, co, cg)]

    def bounds(a):
        lo, hi = win(a, -1, -1).copy(), win(a, -1, -1).copy()
        for o in offs[1:]:
            v = win(a, *o)
            np.minimum(lo, v, out=lo)
            np.maximum(hi, v, out=hi)
        return lo, hi

    box = [bounds(a) for a in (yy, co, cg)]
    s1, s2 = np.zeros((n, w), f32), np.zeros((n, w), f32)
    for o in offs:
        v = win(yy, *o)
        s1 += v
        s2 += v * v
    mean = s1 / f32(9)
    sigma = np.sqrt(np.maximum(f32(0), s2 / f32(9) - mean * mean))
    edge = _smoothstep((box[0][1] - box[0][0] - f32(0.025)) / f32(0.16))
    src = [win(c, 0, 0) / f32(255) for c in (r, g, b)]
    base = [c.copy() for c in src]
    applied = np.zeros((n, w), f32)
    if k.full and k.spatial > 0:
        rng = f32(-1.0 / max(0.004, 0.018 + 0.085 * k.strength))
        acc, sw = [np.zeros((n, w), f32) for _ in range(3)], np.zeros((n, w), f32)
        for dy, dx in offs:
            wt = np.exp(np.abs(win(yy, dy, dx) - centre[0]) * rng) * f32(EDGE_WEIGHTS[abs(dy) + abs(dx)])
            sw += wt
            for a, c in zip(acc, (r, g, b)):
                a += win(c, dy, dx) * wt
        applied = f32(k.spatial * k.strength) * (f32(1) - edge * f32(k.detail))
        for bs, a in zip(base, acc):
            bs += (a / sw / f32(255) - bs) * applied
    hw = np.zeros((n, w), f32)
    new_age = np.ones((n, w), f32)
    rejected = 0
    if hist is not None:
        vx, vy, conf = (p[y0:y1] for p in flow)
        ys, xs = np.indices((n, w), dtype=pad.dtype)
        px, py = xs + vx, ys + f32(y0) + vy
        (hr, hg, hb), ok = bilinear(hist, px, py)
        ix = np.where(ok, np.minimum(w - 1, np.floor(px + f32(0.5))), 0).astype(np.int32)
        iy = np.where(ok, np.minimum(age.shape[0] - 1, np.floor(py + f32(0.5))), 0).astype(np.int32)
        prev_age = np.where(ok, age[iy, ix], 0)
        conf = np.clip(conf, 0, 1)
        can = (conf >= f32(0.08)) & (prev_age > 0)
        hr, hg, hb = hr / f32(255), hg / f32(255), hb / f32(255)
        hy = f32(0.25) * hr + f32(0.5) * hg + f32(0.25) * hb
        ho = f32(0.5) * hr - f32(0.5) * hb
        hc = f32(-0.25) * hr + f32(0.5) * hg - f32(0.25) * hb
        ey = f32(k.expansion) + sigma * f32(0.70)
        ec = f32(k.expansion * 1.35) + sigma * f32(0.45)
        hy = np.minimum(np.maximum(hy, box[0][0] - ey), box[0][1] + ey)
        ho = np.minimum(np.maximum(ho, box[1][0] - ec), box[1][1] + ec)
        hc = np.minimum(np.maximum(hc, box[2][0] - ec), box[2][1] + ec)
        ld = (hy - centre[0]) / f32(k.luma_reject)
        cd = np.maximum(np.abs(ho - centre[1]), np.abs(hc - centre[2])) / f32(k.chroma_reject)
        motion = f32(0.72) + f32(0.28) * np.exp(-np.hypot(vx, vy) / f32(36))
        wt = (f32(k.history * k.strength) * conf * np.exp(-(ld * ld) - cd * cd) * motion
              * np.clip(prev_age / f32(6), f32(0.2), f32(1)) * (f32(1) - f32(0.36) * edge * f32(k.detail)))
        hw = np.where(can, np.clip(wt, 0, f32(0.965)), f32(0)).astype(f32)
        use = hw > f32(0.01)
        mix = np.where(use, hw, f32(0))
        for bs, hv in zip(base, (hy + ho - hc, hy + hc, hy - ho - hc)):
            bs += (np.clip(hv, 0, 1) - bs) * mix
        new_age = np.where(use, np.minimum(k.max_age, prev_age + 1), 1).astype(f32)
        rejected = int(n * w - np.count_nonzero(use))
    back = applied * hw * f32(0.55)
    out = [_round8((bs + (s - bs) * back) * f32(255)) for bs, s in zip(base, src)]
    return out, new_age, (float(hw.sum(dtype=np.float64)), float((applied * (1 - hw)).sum(dtype=np.float64)), rejected,
                          float(new_age.sum(dtype=np.float64)))


def denoise_step(width: int, height: int, settings: Denoise, real=np.float32) -> Callable:
    """Stateful step over the frames of one scene. Rows are worked in bands that stay in cache.

    ``real`` is the element type of the arithmetic; 32 bits are enough for 8-bit colour and twice as fast.
    """
    k = settings.clamped()
    band = max(1, min(height, (1 << 16) // max(1, width)))
    state: dict = {}

    def step(cut, p):
        rgb = np.stack([p[c].reshape(height, width) for c in "rgb"]).astype(real)
        off = k.strength <= 0
        if off or cut:
            state.clear()
        if off:
            return {**dict(zip("rgb", rgb)), "age": np.ones((height, width)), "history_weight": 0.0, "spatial_weight": 0.0,
                    "rejected": 0.0, "mean_age": 0.0}
        pad = np.pad(rgb, ((0, 0), (1, 1), (1, 1)), mode="edge")
        hist, age = state.get("rgb"), state.get("age")
        flow = [p[c].reshape(height, width).astype(real) for c in ("vx", "vy", "confidence")] if hist is not None else None
        out, ages = np.empty_like(rgb), np.empty((height, width), real)
        sums = np.zeros(4)
        for y0 in range(0, height, band):
            y1 = min(height, y0 + band)
            rows, a, st = _denoise_rows(k, pad, y0, y1, hist, age, flow)
            for c in range(3):
                out[c, y0:y1] = rows[c]
            ages[y0:y1] = a
            sums += st
        state["rgb"], state["age"] = list(out), ages
        h, s, rej, ag = sums / float(width * height)
        return {**dict(zip("rgb", out)), "age": ages, "history_weight": h, "spatial_weight": s, "rejected": rej, "mean_age": ag}

    return step


DENOISE_STATS = ["history_weight", "spatial_weight", "rejected", "mean_age"]


def temporal_denoise(planes: DataFrame, width: int, height: int, settings: Denoise = Denoise(), dtype: str = "float") -> DataFrame:
    """Motion-compensated recursive denoiser.

    planes(clip_id, scene_id, frame_no, cut, r, g, b, vx, vy, confidence) -> r, g, b, age planes and the
    frame's mean history weight, spatial weight, rejected share and age. dtype "double" also computes
    in double.
    """
    real = np.float64 if dtype == "double" else np.float32
    return scan(planes, ["r", "g", "b", "vx", "vy", "confidence"], lambda: denoise_step(width, height, settings, real),
                ["r", "g", "b", "age"], DENOISE_STATS, dtype)


def spatial_denoise(px: DataFrame, settings: Denoise = Denoise()) -> DataFrame:
    """The denoiser without history: one neighbourhood pass, no scan, any frame order."""
    k = settings.clamped()
    y = rgb_to_ycocg(F.col("r"), F.col("g"), F.col("b"))["y"] / 255.0
    d = px.select(*KEYS, "y", "x", "r", "g", "b", y.alias("l"))
    n = neighbourhood(d, ["l", "r", "g", "b"])
    sigma = max(0.004, 0.018 + 0.085 * k.strength)
    ls = [c for _, _, c in nine("l")]
    w = [F.exp(-F.abs(c - F.col("l")) / sigma) * EDGE_WEIGHTS[abs(dy) + abs(dx)] for dy, dx, c in nine("l")]
    vals = F.array(*[F.struct(wi.alias("w"), *[v[c].alias(c) for c in "rgb"]) for wi, v in zip(w, [
        F.struct(*[nine(c)[i][2].alias(c) for c in "rgb"]) for i in range(9)])])
    n = n.select(*d.columns, vals.alias("_n"), (F.greatest(*ls) - F.least(*ls)).alias("_range"))
    at = [F.get("_n", F.lit(i)) for i in range(9)]
    sw = _sum([a["w"] for a in at])
    n = n.withColumns({"_sw": sw, **{f"_s{c}": _sum([a[c] * a["w"] for a in at]) for c in "rgb"}}).drop("_n")
    t = clamp01((F.col("_range") - 0.025) / 0.16)
    n = n.withColumn("_t", t).withColumn("_e", F.col("_t") * F.col("_t") * (3.0 - 2.0 * F.col("_t")))
    applied = k.spatial * k.strength * (1.0 - F.col("_e") * k.detail)
    n = n.withColumn("spatial_weight", applied)
    out = {c: F.round(clamp01(F.col(c) / 255.0 + (F.col(f"_s{c}") / F.col("_sw") / 255.0 - F.col(c) / 255.0) * F.col("spatial_weight")) * 255.0)
           for c in "rgb"}
    n = n.withColumns({f"_o{c}": v for c, v in out.items()})
    return n.select(*KEYS, "y", "x", *[big(f"_o{c}").alias(c) for c in "rgb"], "spatial_weight")


def history_age(cells: DataFrame, accept: str = "accept", max_age: int = 24, keys=KEYS) -> DataFrame:
    """Age of each cell's history without motion: frames since the last reset or rejection.

    Gaps and islands per cell track, so it runs in parallel over cells.
    """
    clip, frame = keys
    w = W.partitionBy(clip, "y", "x").orderBy(frame)
    d = cells.withColumn("_reset", F.when(F.col(accept) & (F.lag(frame).over(w) == F.col(frame) - 1), 0).otherwise(1))
    d = d.withColumn("_isle", F.sum("_reset").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    isle = W.partitionBy(clip, "y", "x", "_isle").orderBy(frame)
    return d.withColumn("age", F.least(F.lit(max_age), F.row_number().over(isle)).cast("bigint")).drop("_reset", "_isle")


# ---------------------------------------------------------------------------------------------
# trajectory consensus


def trajectory_consensus(planes: DataFrame, width: int, height: int, mode: str = "auto", grid_step: int = 4, has_depth: bool = False,
                         has_global: bool = False) -> DataFrame:
    """Corrects one-frame phase slips against motion followed through up to three past lattices.

    planes(..., vx, vy, confidence, visibility, uncertainty, disocclusion[, d][, global_x, global_y as
    one-element arrays]). History keeps the corrected field, hence the scan. Publishes the corrected
    vx, vy, confidence, uncertainty planes, corrected share, mean residual and history length.
    """
    fields = ["vx", "vy", "confidence", "visibility", "uncertainty", "disocclusion"]
    fields += (["d"] if has_depth else []) + (["global_x", "global_y"] if has_global else [])
    return scan(planes, fields, lambda: C.plane_step(width, height, mode, grid_step),
                ["vx", "vy", "confidence", "uncertainty"], ["corrected_fraction", "mean_residual", "history"])
