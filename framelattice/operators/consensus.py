"""Trajectory consensus: prediction of a vector from its past, and when to believe it.

One rule in two forms: array code for lattices (``plane_step``) and streams (``vote``), and columns
over lag windows for tracks (``consensus_tracks``), where a cell's identity is known.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import as_col, clamp, clamp01, hypot

# Fixed values by mode.
RULES = {
    "auto": dict(conf=0.64, gate=0.085, base=1.35, slope=0.10, spread=1.20, max_spread=2.75, blend=0.62, protect=0.82, protect_scale=0.38,
                 slip=1.90, min_vis=0.42, max_unc=0.72, samples=1, depth=1, pair_weight=0.18, tri_base=0.28, tri_gain=0.42),
    "strong": dict(conf=0.58, gate=0.055, base=0.85, slope=0.075, spread=1.00, max_spread=2.10, blend=0.90, protect=0.90, protect_scale=0.62,
                   slip=1.55, min_vis=0.34, max_unc=0.80, samples=2, depth=3, pair_weight=0.42, tri_base=0.55, tri_gain=0.45),
}
MAX_SPEED = 2048.0


def history_step(mode: str, grid_step: int) -> int:
    if not 1 <= grid_step <= 4:
        raise ValueError("the grid step is 1 to 4 cells")
    return max(2, grid_step // 2) if mode == "strong" else max(2, grid_step)


def vote(mode: str, cur: dict, past: list[dict], count: np.ndarray, gx=0.0, gy=0.0):
    """Correction (dx, dy), its blend and residual for arrays of current vectors.

    cur: vx, vy, conf, vis, unc, dis; past: newest first, each vx, vy, conf, vis, unc; count: how many of
    ``past`` count for each entry.
    """
    k = RULES[mode]
    n = len(past)
    have = np.arange(n)[:, None] < count[None, :]
    px, py, pc, pv, pu = (np.array([h[f] for h in past]) for f in ("vx", "vy", "conf", "vis", "unc"))

    def median(a):
        a = np.sort(np.where(have, a, np.inf), axis=0)
        lo, hi = np.maximum(0, (count - 1) // 2), np.minimum(n - 1, count // 2)
        i = np.arange(a.shape[1])
        return 0.5 * (a[lo, i] + a[hi, i])

    def mean(a):
        return np.where(have, a, 0.0).sum(axis=0) / np.maximum(count, 1)

    with np.errstate(invalid="ignore"):
        ex, ey = median(px), median(py)
        hc, hu, rel = mean(pc), mean(pu), mean(pc * pv * (1.0 - 0.70 * pu))
        spread = median(np.hypot(px - ex, py - ey))
        if n >= 2:
            ax, ay = px[0] - px[1], py[0] - py[1]
            pw = np.where(count >= 2, k["pair_weight"], 0.0)
            if n >= 3:
                bx, by = px[1] - px[2], py[1] - py[2]
                mag = np.maximum(np.hypot(ax, ay), np.hypot(bx, by))
                agree = np.clip(1.0 - np.hypot(ax - bx, ay - by) / np.maximum(0.65, 0.70 + 0.24 * mag), 0, 1)
                pw = np.where(count >= 3, k["tri_base"] + k["tri_gain"] * agree, pw)
            pw = pw * np.clip(rel, 0, 1)
            ex = np.where(count >= 2, ex + (px[0] + ax - ex) * pw, ex)
            ey = np.where(count >= 2, ey + (py[0] + ay - ey) * pw, ey)
        emag = np.hypot(ex, ey)
        res = np.hypot(cur["vx"] - ex, cur["vy"] - ey)
        thr = (k["base"] + k["slope"] * emag + k["spread"] * spread) * np.clip(1.10 + 0.55 * hu - 0.38 * cur["unc"], 0.72, 1.55)
        stable = spread <= k["max_spread"] + 0.06 * emag
        if mode == "strong":
            fix = stable & (hc >= k["conf"]) & (res > thr)
        else:
            slip = stable & (res > thr * k["slip"])
            fix = stable & (res > thr) & (((cur["conf"] < 0.70) & (hc >= 0.68))
                                          | (slip & (hc >= 0.80) & ((cur["conf"] < 0.92) | (cur["unc"] > 0.45))))
        usable = (np.isfinite(cur["vx"]) & np.isfinite(cur["vy"]) & (np.hypot(cur["vx"], cur["vy"]) <= MAX_SPEED)
                  & (cur["vis"] >= 0.18) & (cur["dis"] <= 0.72) & (count >= k["samples"]))
        sev = np.clip((res - thr) / np.maximum(0.75, thr * 1.6), 0, 1)
        b = (k["blend"] * (0.30 + 0.70 * sev) * (0.45 + 0.55 * rel) * (0.58 + 0.42 * cur["vis"])
             * (0.62 + 0.38 * cur["unc"]) * (1.0 - 0.42 * hu))
        b = np.where((cur["conf"] >= k["protect"]) & (cur["unc"] < 0.36), b * k["protect_scale"], b)
        closer = (np.hypot(gx, gy) > 0.25) & (np.hypot(ex - gx, ey - gy) + 0.5 < np.hypot(cur["vx"] - gx, cur["vy"] - gy))
        b = np.where(closer, np.minimum(k["blend"], b * 1.12), b)
        b = np.where(usable & fix & (b >= 0.04), b, 0.0)
        hit = b > 0
        return np.where(hit, (ex - cur["vx"]) * b, 0.0), np.where(hit, (ey - cur["vy"]) * b, 0.0), b, np.where(hit, res, 0.0)


def _lattice_index(size: int, step: int) -> np.ndarray:
    g = np.arange(-(-size // step))
    return np.minimum(size - 1, np.floor((g + 0.5) * step).astype(int))


def plane_step(width: int, height: int, mode: str, grid_step: int) -> Callable:
    """Stateful step over the frames of one scene; state is at most three corrected lattices."""
    from .scans import bilinear

    k = RULES[mode]
    step_px = history_step(mode, grid_step)
    iy, ix = _lattice_index(height, step_px), _lattice_index(width, step_px)
    gy, gx = np.meshgrid((np.arange(len(iy)) + 0.5) * step_px - 0.5, (np.arange(len(ix)) + 0.5) * step_px - 0.5, indexing="ij")
    py0, px0 = np.minimum(height - 1.0, gy), np.minimum(width - 1.0, gx)
    fy, fx = np.meshgrid((np.arange(height) + 0.5) / step_px - 0.5, (np.arange(width) + 0.5) / step_px - 0.5, indexing="ij")
    names = {"vx": "vx", "vy": "vy", "conf": "confidence", "vis": "visibility", "unc": "uncertainty"}
    past: list[dict] = []

    def lattice(f: dict) -> dict:
        out = {s: f[l][np.ix_(iy, ix)] for s, l in names.items()}
        if "d" in f:
            out["d"] = f["d"][np.ix_(iy, ix)]
        return out

    def trace(cur: dict):
        """History along each lattice point's motion, newest first, and how much of it counts."""
        tx, ty = px0 + cur["vx"], py0 + cur["vy"]
        ref = cur.get("d")
        alive = np.isfinite(tx) & np.isfinite(ty)
        count = np.zeros(tx.shape, int)
        found = []
        for h in past:
            vals, ok = bilinear([h[s] for s in names], np.where(alive, (tx + 0.5) / step_px - 0.5, -1.0), (ty + 0.5) / step_px - 0.5)
            v = dict(zip(names, vals))
            ok &= alive & np.isfinite(v["vx"]) & np.isfinite(v["vy"])
            ok &= (v["conf"] >= k["conf"]) & (v["vis"] >= k["min_vis"]) & (v["unc"] <= k["max_unc"])
            if ref is not None and "d" in h:
                (hd,), inside = bilinear([h["d"]], (tx + 0.5) / step_px - 0.5, (ty + 0.5) / step_px - 0.5)
                same = inside & np.isfinite(hd) & (np.abs(ref - hd) <= np.maximum(k["gate"], 0.06 * np.maximum(np.abs(ref), np.abs(hd))))
                ok &= ~np.isfinite(ref) | same
                ref = np.where(ok & np.isfinite(ref), hd, ref)
            count += ok
            found.append(v)
            tx, ty = np.where(ok, tx + v["vx"], tx), np.where(ok, ty + v["vy"], ty)
            alive = ok & (tx >= 0) & (ty >= 0) & (tx <= width - 1) & (ty <= height - 1)
        return found, count

    def step(cut, p):
        f = {c: p[c].reshape(height, width).astype(np.float64) for c in p if not c.startswith("global")}
        g = [float(p[c][0]) if c in p and len(p[c]) else 0.0 for c in ("global_x", "global_y")]
        res = {"corrected_fraction": 0.0, "mean_residual": 0.0, "history": float(len(past))}
        if cut:
            past.clear()
            return {**{c: f[c] for c in ("vx", "vy", "confidence", "uncertainty")}, **res, "history": 0.0}
        if past:
            cur = lattice(f)
            cur["dis"] = f["disocclusion"][np.ix_(iy, ix)]
            found, count = trace(cur)
            flat = lambda d: {a: b.ravel() for a, b in d.items()}
            dx, dy, b, r = (a.reshape(gx.shape) for a in vote(mode, flat(cur), [flat(h) for h in found], count.ravel(), *g))
            hits = int(np.count_nonzero(b))
            if hits:
                (sx, sy, w), ok = bilinear([dx, dy, b], fx, fy)
                on = ok & (w > 0.001)
                f["vx"] = f["vx"] + np.where(on, sx, 0.0)
                f["vy"] = f["vy"] + np.where(on, sy, 0.0)
                f["confidence"] = np.where(on, np.maximum(f["confidence"], np.minimum(0.92, 0.72 + 0.20 * w)), f["confidence"])
                f["uncertainty"] = np.where(on, np.maximum(0.10, f["uncertainty"] * (1.0 - 0.28 * w)), f["uncertainty"])
                res["corrected_fraction"] = hits / b.size
                res["mean_residual"] = float(r.sum() / hits)
        past.insert(0, lattice(f))
        del past[k["depth"]:]
        return {**{c: f[c] for c in ("vx", "vy", "confidence", "uncertainty")}, **res}

    return step


# ---------------------------------------------------------------------------------------------


def consensus_tracks(tracks: DataFrame, mode: str = "auto", key: str = "track_id", global_x=0.0, global_y=0.0) -> DataFrame:
    """The rule on tracks with raw history: lag windows and columns only.

    tracks(track_id, frame_no, vx, vy, confidence[, visibility, uncertainty, disocclusion]). The first
    frame of a track is its reset and never serves as history.
    """
    k = RULES[mode]
    opt = lambda c, d: F.col(c) if c in tracks.columns else d
    d = tracks.withColumns({"_vis": opt("visibility", F.lit(1.0)), "_unc": opt("uncertainty", 1.0 - F.col("confidence")),
                            "_dis": opt("disocclusion", F.lit(0.0))})
    w = W.partitionBy(key).orderBy("frame_no")
    d = d.withColumn("_n", F.row_number().over(w))
    item = F.struct("vx", "vy", F.col("confidence").alias("c"), F.col("_vis").alias("v"), F.col("_unc").alias("u"), "_n")
    for i in range(1, k["depth"] + 1):
        h = F.lag(item, i).over(w)
        ok = (h["_n"] >= 2) & (h["c"] >= k["conf"]) & (h["v"] >= k["min_vis"]) & (h["u"] <= k["max_unc"])
        d = d.withColumn(f"_h{i}", F.when(ok, h))
    h = [F.col(f"_h{i}") for i in range(1, k["depth"] + 1)]
    # history ends at the first entry that does not qualify
    for i in range(1, len(h)):
        d = d.withColumn(f"_h{i + 1}", F.when(F.col(f"_h{i}").isNotNull(), F.col(f"_h{i + 1}")))
    count = sum((x.isNotNull().cast("int") for x in h), F.lit(0))
    d = d.withColumn("_count", count)

    def median(vals):
        s = F.array_sort(F.array_compact(F.array(*vals)))
        n = F.size(s)
        return F.when(n > 0, 0.5 * (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))))

    def mean(f):
        return sum((F.coalesce(f(x), F.lit(0.0)) for x in h), F.lit(0.0)) / F.greatest(F.col("_count"), F.lit(1))

    d = d.withColumns({"_ex": median([x["vx"] for x in h]), "_ey": median([x["vy"] for x in h]), "_hc": mean(lambda x: x["c"]),
                       "_hu": mean(lambda x: x["u"]), "_rel": mean(lambda x: x["c"] * x["v"] * (1.0 - 0.70 * x["u"]))})
    d = d.withColumn("_spread", median([hypot(x["vx"] - F.col("_ex"), x["vy"] - F.col("_ey")) for x in h]))
    if k["depth"] >= 2:
        ax, ay = h[0]["vx"] - h[1]["vx"], h[0]["vy"] - h[1]["vy"]
        bx, by = h[1]["vx"] - h[2]["vx"], h[1]["vy"] - h[2]["vy"]
        mag = F.greatest(hypot(ax, ay), hypot(bx, by))
        agree = clamp01(1.0 - hypot(ax - bx, ay - by) / F.greatest(F.lit(0.65), 0.70 + 0.24 * mag))
        pw = F.when(F.col("_count") >= 3, k["tri_base"] + k["tri_gain"] * agree).when(F.col("_count") == 2, k["pair_weight"]).otherwise(0.0)
        d = d.withColumn("_pw", pw * clamp01(F.col("_rel")))
        d = d.withColumns({"_ex": F.when(F.col("_count") >= 2, F.col("_ex") + (h[0]["vx"] + ax - F.col("_ex")) * F.col("_pw")).otherwise(F.col("_ex")),
                           "_ey": F.when(F.col("_count") >= 2, F.col("_ey") + (h[0]["vy"] + ay - F.col("_ey")) * F.col("_pw")).otherwise(F.col("_ey"))})
    ex, ey, hc, hu = (F.col(c) for c in ("_ex", "_ey", "_hc", "_hu"))
    d = d.withColumns({"_em": hypot(ex, ey), "residual": hypot(F.col("vx") - ex, F.col("vy") - ey)})
    d = d.withColumn("_thr", (k["base"] + k["slope"] * F.col("_em") + k["spread"] * F.col("_spread"))
                     * clamp(1.10 + 0.55 * hu - 0.38 * F.col("_unc"), 0.72, 1.55))
    res, thr, conf, unc = F.col("residual"), F.col("_thr"), F.col("confidence"), F.col("_unc")
    stable = F.col("_spread") <= k["max_spread"] + 0.06 * F.col("_em")
    if mode == "strong":
        fix = stable & (hc >= k["conf"]) & (res > thr)
    else:
        fix = stable & (res > thr) & (((conf < 0.70) & (hc >= 0.68)) | (
            (res > thr * k["slip"]) & (hc >= 0.80) & ((conf < 0.92) | (unc > 0.45))))
    usable = (hypot(F.col("vx"), F.col("vy")) <= MAX_SPEED) & (F.col("_vis") >= 0.18) & (F.col("_dis") <= 0.72) & (F.col("_count") >= k["samples"])
    sev = clamp01((res - thr) / F.greatest(F.lit(0.75), thr * 1.6))
    b = (k["blend"] * (0.30 + 0.70 * sev) * (0.45 + 0.55 * F.col("_rel")) * (0.58 + 0.42 * F.col("_vis")) * (0.62 + 0.38 * unc) * (1.0 - 0.42 * hu)
         * F.when((conf >= k["protect"]) & (unc < 0.36), k["protect_scale"]).otherwise(1.0))
    d = d.withColumns({"_fix": F.coalesce(usable & fix, F.lit(False)), "_b": b})
    gx, gy = as_col(global_x), as_col(global_y)
    closer = (hypot(gx, gy) > 0.25) & (hypot(ex - gx, ey - gy) + 0.5 < hypot(F.col("vx") - gx, F.col("vy") - gy))
    d = d.withColumn("_b", F.when(closer, F.least(F.lit(k["blend"]), F.col("_b") * 1.12)).otherwise(F.col("_b")))
    hit = F.col("_fix") & (F.col("_b") >= 0.04)
    d = d.withColumn("blend", F.when(hit, F.col("_b")).otherwise(0.0))
    return d.select(*tracks.columns, F.col("_count").alias("history"), "blend",
                    F.when(hit, F.col("vx") + (ex - F.col("vx")) * F.col("blend")).otherwise(F.col("vx")).alias("out_vx"),
                    F.when(hit, F.col("vy") + (ey - F.col("vy")) * F.col("blend")).otherwise(F.col("vy")).alias("out_vy"))
