"""Reliability of grid motion, robust camera motion, repair and the two guidance policies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import KEYS, clamp01, finite, frac, hypot
from ..functions.colour import cost01, decode_fixed, luma
from ..sources.fields import long_to_planes
from .lattice import at_position, attach_planes, inside, landing_coverage, sample_bilinear, shift_frames, with_position

# Fixed values of repair, by mode.
REPAIR = {
    "auto": dict(reject=0.46, trusted=0.70, gate=0.060, blend=0.85, min_vis=0.52, max_unc=0.64, rings=2, protect=0.90,
                 radius=1.35, radius_slope=0.14, share=0.56),
    "strong": dict(reject=0.60, trusted=0.76, gate=0.040, blend=1.0, min_vis=0.42, max_unc=0.72, rings=3, protect=0.94,
                   radius=1.10, radius_slope=0.10, share=0.46),
}
# Fixed values of the conservative policy, by mode.
SAFE = {
    "auto": dict(protect=0.76, below=0.54, hard=0.28, blend=0.46, floor=0.08),
    "strong": dict(protect=0.82, below=0.64, hard=0.34, blend=0.60, floor=0.10),
}
# Directions (dx, dy) of one ring, in voting order.
RING = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1))
MAX_SPEED = 2048.0
MIN_SAMPLES = 24


def grid_reliability(grid: DataFrame, px: DataFrame, width: int, height: int, grid_w: int, grid_h: int, backward: bool = True,
                     cost: bool = True, photometric: bool = True, segments: DataFrame | None = None) -> DataFrame:
    """Packed grid motion to full-resolution vectors with five reliability fields.

    grid(gy, gx, fx, fy[, bx, by_][, cost_f, cost_b]), px(r, g, b). The grid's planes (a small
    fraction of the image) join each frame once and all samples of them are element reads; only the
    previous frame's luma is a second lookup. ``backward``, ``cost`` and ``photometric`` say which
    evidence exists; missing evidence counts .80.
    """
    g = grid.select(*KEYS, "gy", "gx", decode_fixed(F.col("fx")).alias("fx"), decode_fixed(F.col("fy")).alias("fy"),
                    *([decode_fixed(F.col("bx")).alias("bx"), decode_fixed(F.col("by_")).alias("by")] if backward else []),
                    *([cost01(F.col("cost_f")).alias("cf"), cost01(F.col("cost_b")).alias("cb")] if cost else []))
    names = [c for c in g.columns if c not in (*KEYS, "gy", "gx")]
    g = g.join(landing_coverage(g, "fx", "fy", grid_w, grid_h, width, height, "fl"), [*KEYS, "gy", "gx"])
    names.append("fl")
    if backward:
        g = g.join(landing_coverage(g, "bx", "by", grid_w, grid_h, width, height, "bl"), [*KEYS, "gy", "gx"])
        names.append("bl")
    planes = long_to_planes(g.withColumnsRenamed({"gy": "y", "gx": "x"}), names).withColumnsRenamed({n: f"_{n}" for n in names})

    lum = px.select(*KEYS, "y", "x", (luma(F.col("r"), F.col("g"), F.col("b")) / 255.0).alias("l"))
    sx, sy = grid_w / width, grid_h / height
    d = with_position(lum, "q", (F.col("x") + 0.5) * sx - 0.5, (F.col("y") + 0.5) * sy - 0.5, grid_w, grid_h)
    d = attach_planes(d, planes, how="inner")
    point8 = F.lit(0.80)
    d = d.withColumns({
        "vx": at_position("_fx", "q"), "vy": at_position("_fy", "q"),
        "_ccf": clamp01(1.0 - at_position("_cf", "q")) if cost else point8,
        "_rev": F.greatest(F.lit(0.0), at_position("_bl", "q")) if backward else F.lit(1.0)})
    d = d.withColumns({"_px": F.col("x") + F.col("vx"), "_py": F.col("y") + F.col("vy")})
    d = d.withColumn("_in", inside(F.col("_px"), F.col("_py"), width, height))
    d = with_position(d, "p", (F.col("_px") + 0.5) * sx - 0.5, (F.col("_py") + 0.5) * sy - 0.5, grid_w, grid_h)
    d = d.withColumns({
        "_fb": F.when(F.col("_in"), hypot(F.col("vx") + at_position("_bx", "p"), F.col("vy") + at_position("_by", "p"))).otherwise(1000.0)
        if backward else F.lit(0.0),
        "_ccb": F.when(F.col("_in"), clamp01(1.0 - at_position("_cb", "p")) if cost else point8).otherwise(0.0) if backward else point8,
        "_fd": F.greatest(F.lit(0.0), at_position("_fl", "p"))})
    d = d.select(*KEYS, "y", "x", "l", "vx", "vy", "_px", "_py", "_in", "_ccf", "_ccb", "_rev", "_fb", "_fd")
    if photometric:
        d = sample_bilinear(d, shift_frames(lum), {"l": "_pl"}, "_px", "_py", width, height)
        seen = F.col("_in") & F.col("_pl").isNotNull()
        d = d.withColumn("_hist", seen).withColumn(
            "_cp", F.when(F.col("_hist"), F.exp(-F.abs(F.col("l") - F.col("_pl")) / 0.075)).otherwise(0.0))
    else:
        d = d.withColumn("_hist", F.col("_in")).withColumn("_cp", point8)
    d = d.withColumns({
        "_cfb": (F.when(F.col("_in"), F.exp(-F.col("_fb") / 1.35)).otherwise(0.0) if backward else point8),
        "disocclusion": F.greatest(F.when(F.col("_hist"), 0.0).otherwise(1.0), clamp01((0.80 - F.col("_rev")) / 0.80)),
        "occlusion": F.when(F.col("_hist"), clamp01((F.col("_fd") - 1.20) / 1.40)).otherwise(0.0),
        "_pair": F.sqrt(F.greatest(F.lit(0.0), F.col("_ccf") * F.col("_ccb")))})
    fbvis = F.exp(-F.col("_fb") / 2.25) if backward else F.when(F.col("_hist"), 0.85).otherwise(0.0)
    d = d.withColumn("visibility", clamp01(fbvis * (1.0 - F.col("disocclusion")) * (1.0 - 0.55 * F.col("occlusion"))))
    d = d.withColumns({
        "confidence": clamp01(0.25 * F.col("_pair") + 0.50 * F.col("_cfb") + 0.25 * F.col("_cp")),
        "_ev": clamp01(0.30 * F.col("_pair") + 0.30 * F.col("_cfb") + 0.15 * F.col("_cp") + 0.25 * F.col("visibility"))})
    d = d.withColumn("uncertainty", clamp01(F.greatest(1.0 - F.col("_ev"), 0.78 * F.col("disocclusion"), 0.48 * F.col("occlusion"))))
    fields = {"vx": 0.0, "vy": 0.0, "confidence": 0.0, "visibility": 0.0, "occlusion": 0.0, "disocclusion": 0.0, "uncertainty": 1.0}
    out = d.select(*KEYS, "y", "x", *fields)
    if segments is not None:
        out = out.join(segments.select(*KEYS, "cut"), list(KEYS), "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
        out = out.withColumns({c: F.when(F.col("cut"), v).otherwise(F.col(c)) for c, v in fields.items()}).drop("cut")
    return out.withColumns({"raw_vx": F.col("vx"), "raw_vy": F.col("vy")})


def reliability_rollup(flow: DataFrame) -> DataFrame:
    return flow.groupBy(*KEYS).agg(
        F.avg("visibility").alias("mean_history_visibility"), frac(F.col("disocclusion") >= 0.5).alias("disoccluded_fraction"),
        frac(F.col("occlusion") >= 0.5).alias("occlusion_ambiguous_fraction"),
        frac(F.col("uncertainty") >= 0.65).alias("high_uncertainty_fraction"))


# ---------------------------------------------------------------------------------------------


def _opt(df: DataFrame, name: str, default: Column) -> Column:
    return clamp01(F.coalesce(F.col(name), default)) if name in df.columns else default


def reliability_columns(flow: DataFrame) -> DataFrame:
    """Fills absent optional fields with their defaults and clamps them."""
    conf = clamp01(F.col("confidence"))
    return flow.withColumns({
        "_conf": conf, "_vis": _opt(flow, "visibility", F.lit(1.0)), "_dis": _opt(flow, "disocclusion", F.lit(0.0)),
        "_occ": _opt(flow, "occlusion", F.lit(0.0)), "_unc": _opt(flow, "uncertainty", 1.0 - conf)})


def fit_affine_motion(flow: DataFrame, width: int, height: int, mode: str = "auto", stride: int = 1) -> DataFrame:
    """Robust 2x3 camera motion per frame: v = v0 + vx * nx + vy * ny in centred coordinates.

    Three reweighted least-squares rounds over the trusted ones of every stride-th cell both ways (1: all). All rounds are
    whole-frame window aggregates over one exchange of those cells. Frames without enough samples or a usable solution have no row.
    """
    cx, cy, scale = 0.5 * (width - 1), 0.5 * (height - 1), max(1.0, 0.5 * max(width, height))
    on = (F.col("y") % stride == stride // 2) & (F.col("x") % stride == stride // 2)
    s = reliability_columns(flow.where(on))
    s = s.where((F.col("_conf") >= REPAIR[mode]["trusted"]) & (F.col("_vis") >= 0.45) & (F.col("_unc") <= 0.65)
                & finite(F.col("vx")) & finite(F.col("vy")) & (hypot(F.col("vx"), F.col("vy")) <= MAX_SPEED))
    s = s.select(*KEYS, ((F.col("x") - cx) / scale).alias("nx"), ((F.col("y") - cy) / scale).alias("ny"), "vx", "vy",
                 F.greatest(F.lit(1e-3), F.col("_conf") * F.col("_vis") * (1.0 - 0.65 * F.col("_unc"))).alias("bw"))
    w = W.partitionBy(*KEYS)
    s = s.repartition(*KEYS).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= MIN_SAMPLES).withColumn("rw", F.lit(1.0))
    for i in range(3):
        s = s.withColumn("w", F.col("bw") * F.col("rw"))
        terms = {"s0": F.lit(1.0), "sx": F.col("nx"), "sy": F.col("ny"), "sxx": F.col("nx") * F.col("nx"),
                 "sxy": F.col("nx") * F.col("ny"), "syy": F.col("ny") * F.col("ny")}
        for a in ("vx", "vy"):
            terms.update({f"{a}0": F.col(a), f"{a}1": F.col(a) * F.col("nx"), f"{a}2": F.col(a) * F.col("ny")})
        sums = {k: F.sum(F.col("w") * v) for k, v in terms.items()}
        if i == 2:
            # the last round needs no new weights, so it is a plain aggregation to one row per frame
            m = s.groupBy(*KEYS).agg(F.max("n").alias("samples"), *[v.alias(f"_{k}") for k, v in sums.items()])
            m = _solve(m)
            return m.where("_ok").select(*KEYS, "vx0", "vxx", "vxy", "vy0", "vyx", "vyy", "samples")
        # withColumns keeps all sums in one window pass
        s = s.withColumns({f"_{k}": v.over(w) for k, v in sums.items()})
        s = _solve(s).where("_ok")
        res = hypot(F.col("vx") - (F.col("vx0") + F.col("vxx") * F.col("nx") + F.col("vxy") * F.col("ny")),
                    F.col("vy") - (F.col("vy0") + F.col("vyx") * F.col("nx") + F.col("vyy") * F.col("ny")))
        s = s.select(*KEYS, "nx", "ny", "vx", "vy", "bw", "n", res.alias("res"))
        s = s.withColumn("med", F.median("res").over(w)).withColumn("mad", F.median(F.abs(F.col("res") - F.col("med"))).over(w))
        huber = F.greatest(F.lit(0.75), F.col("med") + 1.75 * F.greatest(F.lit(0.35), 1.4826 * F.col("mad")))
        s = s.withColumn("_h", huber).withColumn(
            "rw", F.when(F.col("res") <= F.col("_h"), 1.0).otherwise(F.col("_h") / F.greatest(F.col("res"), F.lit(1e-5))))
        s = s.select(*KEYS, "nx", "ny", "vx", "vy", "bw", "n", "rw")
    raise AssertionError("unreachable")


def _solve(d: DataFrame) -> DataFrame:
    """Closed-form elimination of the symmetric 3x3 normal equations; ``_ok`` needs every pivot."""
    c = lambda n: F.col(f"_{n}")
    keep = [n for n in d.columns if not n.startswith("_")]
    d = d.withColumns({"_a2": c("sx") / c("s0"), "_a3": c("sy") / c("s0")})
    d = d.withColumns({"_d22": c("sxx") - c("sx") * c("a2"), "_d23": c("sxy") - c("sx") * c("a3"), "_d33": c("syy") - c("sy") * c("a3")})
    d = d.withColumns({"_a23": c("d23") / c("d22")}).withColumns({"_e33": c("d33") - c("d23") * c("a23")})
    d = d.withColumn("_ok", (c("s0") >= 1e-7) & (c("d22") >= 1e-7) & (c("e33") >= 1e-7))
    out = {}
    for a, (k0, k1, k2) in (("vx", ("vx0", "vxx", "vxy")), ("vy", ("vy0", "vyx", "vyy"))):
        d = d.withColumns({f"_{a}r2": c(f"{a}1") - c(f"{a}0") * c("a2"), f"_{a}r3": c(f"{a}2") - c(f"{a}0") * c("a3")})
        d = d.withColumn(f"_{a}c3", (c(f"{a}r3") - c(f"{a}r2") * c("a23")) / c("e33"))
        d = d.withColumn(f"_{a}c2", (c(f"{a}r2") - c("d23") * c(f"{a}c3")) / c("d22"))
        d = d.withColumn(f"_{a}c1", (c(f"{a}0") - c("sx") * c(f"{a}c2") - c("sy") * c(f"{a}c3")) / c("s0"))
        out.update({k0: c(f"{a}c1"), k1: c(f"{a}c2"), k2: c(f"{a}c3")})
    return d.select(*keep, "_ok", *[v.alias(k) for k, v in out.items()])


def _vote(vx: np.ndarray, vy: np.ndarray, w: np.ndarray, radius: float, slope: float) -> tuple[np.ndarray, ...]:
    """Weighted medoid of every column's entries with w > 0, and the mode around it: (entries, entries near, weight, weight near, x, y).

    Arrays are (entries, cells); ties keep the earlier entry.
    """
    score = np.zeros_like(w)
    for bx, by, bw in zip(vx, vy, w):
        score += bw * np.sqrt((vx - bx) ** 2 + (vy - by) ** 2)
    best = np.where(w > 0, score, np.inf).argmin(0)[None]
    mx, my = np.take_along_axis(vx, best, 0), np.take_along_axis(vy, best, 0)
    near = (w > 0) & (np.sqrt((vx - mx) ** 2 + (vy - my) ** 2) <= radius + slope * np.sqrt(mx * mx + my * my))
    nw = np.where(near, w, 0.0)
    return (w > 0).sum(0), near.sum(0), w.sum(0), nw.sum(0), (vx * nw).sum(0), (vy * nw).sum(0)


def _with_votes(cells: DataFrame, k: dict, step: int, width: int, gated: bool, drop: tuple[str, ...] = ("_w", "d")) -> DataFrame:
    """Adds the dominant motion around every ``_bad`` cell: _count (voters), _coh, _local (the mode is one), _lx, _ly.

    cells(vx, vy, _w, _bad[, d]) lie with their frame. They pass through in lattice order, and a task holds as many image rows as the
    rings reach, whatever the frame's size; the votes of the bad cells among them are arrays.
    """
    reach = k["rings"] * step
    ahead = reach * (width + 1)  # a cell's neighbours are at most so many rows before or behind it
    offsets = [(r, dx * r * step, dy * r * step) for r in range(1, k["rings"] + 1) for dx, dy in RING]
    fields = ["vx", "vy", "_w", *(["d"] if gated else [])]
    keep = [c for c in cells.columns if c not in drop]
    double = lambda t, c: t[c].to_numpy().astype(float)

    def publish(t: pa.Table, lo: int, hi: int) -> pa.Table:
        """Rows lo to hi of a stretch that has all their neighbours."""
        y, x, frame = t["y"].to_numpy(), t["x"].to_numpy(), t["_frame"].to_numpy()
        v = {c: double(t, c) for c in fields}
        across, down = np.ptp(x) + 1 + 2 * reach, np.ptp(y) + 1 + 2 * reach
        place = (np.r_[0, np.cumsum(frame[1:] != frame[:-1])] * down + y - y.min()) * across + x - x.min()
        bad = lo + np.flatnonzero(t["_bad"].slice(lo, hi - lo).fill_null(False).to_numpy())
        count, coh, local = np.zeros(hi - lo, np.int32), np.zeros(hi - lo), np.zeros(hi - lo, bool)
        lx, ly = np.full(hi - lo, np.nan), np.full(hi - lo, np.nan)
        for at in range(0, len(bad), 2000):
            i = bad[at:at + 2000]
            around = np.zeros((3, len(offsets), len(i)))
            for j, (r, dx, dy) in enumerate(offsets):
                want = place[i] + dy * across + dx
                p = np.clip(i + dy * width + dx, 0, len(place) - 1)  # where it lies if no cell is missing
                miss = np.flatnonzero(place[p] != want)
                p[miss] = np.minimum(np.searchsorted(place, want[miss]), len(place) - 1)
                w = v["_w"][p] / float(r)
                ok = (place[p] == want) & (w > 0)
                if gated:
                    a, b = v["d"][i], v["d"][p]
                    with np.errstate(invalid="ignore"):
                        ok &= np.isfinite(a) & np.isfinite(b) & (np.abs(a - b) <= np.maximum(k["gate"], 0.05 * np.maximum(np.abs(a), np.abs(b))))
                around[:, j] = np.where(ok, (v["vx"][p], v["vy"][p], w), 0.0)
            with np.errstate(invalid="ignore", divide="ignore"):
                n, near, total, weight, sx, sy = _vote(*around, k["radius"], k["radius_slope"])
                share = np.where((n >= 2) & (total > 1e-6), weight / total, 0.0)
                o = i - lo
                count[o], coh[o], lx[o], ly[o] = n, share, sx / weight, sy / weight
                local[o] = (n >= 2) & (near >= 2) & (weight > 1e-6) & (share >= k["share"])
        out = t.slice(lo, hi - lo).select(keep)
        for name, c in (("_count", count), ("_coh", coh), ("_local", local), ("_lx", lx), ("_ly", ly)):
            out = out.append_column(name, pa.array(c))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows before `done` are published and held as neighbours
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows - done >= max(20_000, 3 * ahead):
                held, until = held.combine_chunks(), held.num_rows - ahead
                yield from publish(held, done, until).to_batches()
                first = max(0, until - ahead)
                held, done = held.slice(first), until - first
        if held is not None and held.num_rows > done:
            yield from publish(held.combine_chunks(), done, held.num_rows).to_batches()

    d = cells.withColumn("_frame", F.xxhash64(*KEYS)).sortWithinPartitions(*KEYS, "y", "x")
    added = [T.StructField("_count", T.IntegerType()), T.StructField("_coh", T.DoubleType()), T.StructField("_local", T.BooleanType()),
             T.StructField("_lx", T.DoubleType()), T.StructField("_ly", T.DoubleType())]
    return d.mapInArrow(run, T.StructType([cells.schema[c] for c in keep] + added))


def repair_rejected(flow: DataFrame, width: int, height: int, mode: str = "auto", step: int = 4, depth: DataFrame | str | None = None,
                    model: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """Replaces distrusted vectors by the dominant motion around them, or by the camera motion.

    Neighbours are read from the input as it was, so the result does not depend on any order. depth(d)
    restricts neighbours to the same surface; "d" if it is a column of flow already. stride: of the camera fit, where no model is given. Adds ``repaired``: local, affine or null.
    """
    k = REPAIR[mode]
    if not 1 <= step <= 8:
        raise ValueError("the ring step is 1 to 8 cells")
    model = fit_affine_motion(flow, width, height, mode, stride) if model is None else model
    own = isinstance(depth, str)
    if own and depth != "d":
        raise ValueError("depth is a table or the column d")
    d = flow if depth is None or own else flow.join(depth.select(*KEYS, "y", "x", "d"), [*KEYS, "y", "x"], "left")
    d = reliability_columns(d)
    eligible = (F.col("confidence") >= k["reject"]) & (F.col("_vis") >= k["min_vis"]) & (F.col("_unc") <= k["max_unc"])
    d = d.withColumns({
        "_w": F.when(eligible, F.col("confidence") * F.col("_vis") * (1.0 - 0.65 * F.col("_unc"))).otherwise(0.0),
        "_trust": F.col("_conf") * (0.55 + 0.45 * F.col("_vis")) * (1.0 - 0.58 * F.col("_unc"))})
    protected = (F.col("_conf") >= k["protect"]) & (F.col("_unc") <= 0.24) & (F.col("_vis") >= 0.72)
    d = d.withColumn("_bad", ~protected & (F.col("_trust") < k["reject"]))
    # one model row per frame
    scale = max(1.0, 0.5 * max(width, height))
    nx, ny = (F.col("x") - 0.5 * (width - 1)) / scale, (F.col("y") - 0.5 * (height - 1)) / scale
    d = d.repartition(*KEYS).join(model.select(*KEYS, "vx0", "vxx", "vxy", "vy0", "vyx", "vyy"), list(KEYS), "left")
    d = d.select(*flow.columns, "_dis", "_trust", "_bad", "_w", (F.col("vx0") + F.col("vxx") * nx + F.col("vxy") * ny).alias("_ax"),
                 (F.col("vy0") + F.col("vyx") * nx + F.col("vyy") * ny).alias("_ay"), *(["d"] if depth is not None and not own else []))
    n = _with_votes(d, k, step, width, depth is not None, ("_w",) if own else ("_w", "d"))
    affine = F.col("_bad") & ~F.col("_local") & F.col("_ax").isNotNull() & (F.col("_dis") < 0.45)
    n = n.withColumn("repaired", F.when(F.col("_bad") & F.col("_local"), "local").when(affine, "affine"))
    tx = F.when(F.col("repaired") == "local", F.col("_lx")).otherwise(F.col("_ax"))
    ty = F.when(F.col("repaired") == "local", F.col("_ly")).otherwise(F.col("_ay"))
    severity = clamp01((k["reject"] - F.col("_trust")) / k["reject"])
    n = n.withColumns({"_tx": tx, "_ty": ty, "_b": k["blend"] * (0.35 + 0.65 * severity)})
    hit = F.col("repaired").isNotNull()
    new = {"vx": F.when(hit, F.col("vx") + (F.col("_tx") - F.col("vx")) * F.col("_b")).otherwise(F.col("vx")),
           "vy": F.when(hit, F.col("vy") + (F.col("_ty") - F.col("vy")) * F.col("_b")).otherwise(F.col("vy"))}
    if "uncertainty" in flow.columns:
        new["uncertainty"] = F.when(hit & (F.col("_count") >= 2), F.greatest(
            F.col("_dis") * 0.75, F.least(F.col("uncertainty"), 0.76 - 0.28 * clamp01(F.col("_coh"))))).otherwise(F.col("uncertainty"))
    return n.withColumns(new).select(*flow.columns, "repaired")


def refine_with_depth(flow: DataFrame, depth: DataFrame | None, width: int, height: int, mode: str = "auto", step: int = 4,
                      stride: int = 1) -> DataFrame:
    """Repair after fusion; depth, where there is any, keeps motion from crossing silhouettes."""
    return repair_rejected(flow, width, height, mode, step, depth, stride=stride)


def repair_diagnostics(repaired: DataFrame, model: DataFrame, width: int, height: int) -> DataFrame:
    """Repaired shares per frame and the camera motion at the image centre."""
    d = repaired.groupBy(*KEYS).agg(frac(F.col("repaired").isNotNull()).alias("repaired_fraction"),
                                    frac(F.coalesce(F.col("repaired") == "local", F.lit(False))).alias("local_mode_repair_fraction"),
                                    frac(F.coalesce(F.col("repaired") == "affine", F.lit(False))).alias("affine_fallback_fraction"))
    m = model.select(*KEYS, F.col("vx0").alias("global_mv_x"), F.col("vy0").alias("global_mv_y"))
    return d.join(m, list(KEYS), "left").fillna(0.0, ["global_mv_x", "global_mv_y"])


def with_repair(flow: DataFrame, width: int, height: int, mode: str = "auto", step: int = 4,
                depth: DataFrame | str | None = None, model: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """Repaired field with the unrepaired uncertainty riding along as ``_u0``: both policies read it."""
    src = flow.withColumn("_u0", F.col("uncertainty")) if "uncertainty" in flow.columns else flow
    return repair_rejected(src, width, height, mode, step, depth, model, stride)


def safe_motion(flow: DataFrame, width: int, height: int, mode: str = "auto", step: int = 4, depth: DataFrame | None = None,
                stride: int = 1) -> DataFrame:
    """Conservative field: bounded steps from the raw vector towards the repaired one, and a history
    confidence that falls with disagreement, occlusion and rejection.

    flow also carries raw_vx, raw_vy. Adds ``corrected`` and ``rejected``.
    """
    return safe_policy(with_repair(flow, width, height, mode, step, depth, stride=stride), flow.columns, width, height, mode)


def safe_policy(repaired: DataFrame, columns: list[str], width: int, height: int, mode: str = "auto") -> DataFrame:
    """The conservative policy on a field made by ``with_repair``: columns of the same row only."""
    k = SAFE[mode]
    c = repaired
    if "_u0" in c.columns:  # this policy judges by the uncertainty before the repair
        c = c.drop("uncertainty").withColumnRenamed("_u0", "uncertainty")
    c = c.withColumnsRenamed({"vx": "_cx", "vy": "_cy"})
    d = reliability_columns(c)
    rx, ry = F.col("raw_vx"), F.col("raw_vy")
    d = d.withColumns({
        "_fin": finite(rx) & finite(ry) & finite(F.col("_cx")) & finite(F.col("_cy")),
        "_delta": hypot(F.col("_cx") - rx, F.col("_cy") - ry), "_mag": hypot(rx, ry)})
    conf, vis, dis, occ, unc, delta = (F.col(n) for n in ("_conf", "_vis", "_dis", "_occ", "_unc", "_delta"))
    d = d.withColumns({"_safe": 1.25 + 0.18 * F.col("_mag"), "_severe": 3.0 + 0.30 * F.col("_mag"),
                       "_arb": conf * (0.45 + 0.55 * vis) * (1.0 - 0.40 * unc)})
    safe, severe, arb = F.col("_safe"), F.col("_severe"), F.col("_arb")
    severity = clamp01((k["below"] - arb) / k["below"])
    agreement = clamp01(1.0 - F.greatest(F.lit(0.0), delta - safe) / F.greatest(F.lit(1.0), severe))
    blend = (k["blend"] * (0.22 + 0.78 * severity) * (0.45 + 0.55 * agreement) * F.when(arb > k["below"], 0.35).otherwise(1.0)
             * (0.55 + 0.45 * (1.0 - dis)))
    d = d.withColumn("_bl", F.when(F.col("_fin") & (arb < k["protect"]) & (delta > 0.05), blend).otherwise(0.0))
    d = d.withColumn("corrected", F.col("_bl") > 0.02)
    d = d.withColumns({
        "vx": F.when(F.col("corrected"), rx + (F.col("_cx") - rx) * F.col("_bl")).otherwise(rx),
        "vy": F.when(F.col("corrected"), ry + (F.col("_cy") - ry) * F.col("_bl")).otherwise(ry),
        "_h": conf * vis * (1.0 - 0.65 * unc) * (1.0 - 0.35 * occ) * F.when(
            delta > safe, 1.0 - 0.70 * clamp01((delta - safe) / F.greatest(F.lit(1.0), severe - safe))).otherwise(1.0)})
    h = F.when(conf < k["hard"], F.least(F.col("_h"), F.lit(k["floor"]))).otherwise(F.col("_h"))
    h = F.when((dis >= 0.80) | (vis <= 0.10), 0.0).when(dis >= 0.50, F.least(h, F.lit(0.04))).otherwise(h)
    d = d.withColumn("_h", h)
    ok = F.col("_fin") & inside(F.col("x") + F.col("vx"), F.col("y") + F.col("vy"), width, height)
    d = d.withColumn("confidence", F.when(ok, clamp01(F.col("_h"))).otherwise(0.0))
    return d.withColumn("rejected", F.col("confidence") < 0.08).select(*columns, "corrected", "rejected")


def safe_diagnostics(safe: DataFrame) -> DataFrame:
    return safe.groupBy(*KEYS).agg(frac(F.col("corrected")).alias("nr_safe_corrected_fraction"),
                                   frac(F.col("rejected")).alias("nr_history_rejected_fraction"))
