"""Motion estimation, confidence, conditioning and cross-scale fusion (parallel over frames)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import KEYS, clamp01, finite, hypot
from ..functions.colour import import_motion, luma
from ..sources.fields import long_to_planes
from .lattice import (_sum, gauss3x3, inside, invert_flow, median3x3, neighbourhood, sample_bilinear,
                      pair_previous, shift_frames)

# Block search.
DISTANCE_PRIOR = 0.0015
MATCH_SLOPE = 2.5
FILL_BELOW = 0.18
FILL_SHARE = 0.55

_BLOCKS = "clip_id long, frame_no long, gy long, gx long, vx double, vy double, confidence double"


def _match_blocks(prev: np.ndarray, cur: np.ndarray, block: int, radius: int):
    """Exhaustive search of every block centre of one frame pair; arrays over (gy, gx)."""
    h, w = cur.shape
    cy = np.minimum(h - 1, np.arange(-(-h // block)) * block + block // 2)
    cx = np.minimum(w - 1, np.arange(-(-w // block)) * block + block // 2)
    o = np.arange(-(block // 2), block // 2 + 1, 2)
    ys, xs = cy[:, None] + o, cx[:, None] + o
    ok_y, ok_x = (ys >= 0) & (ys < h), (xs >= 0) & (xs < w)
    here = cur[np.clip(ys, 0, h - 1)[:, None, :, None], np.clip(xs, 0, w - 1)[None, :, None, :]]
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    raw = np.full((len(steps), len(cy), len(cx)), np.inf)
    for k, (dy, dx) in enumerate(steps):
        vy, vx = ys + dy, xs + dx
        ok = (ok_y & (vy >= 0) & (vy < h))[:, None, :, None] & (ok_x & (vx >= 0) & (vx < w))[None, :, None, :]
        there = prev[np.clip(vy, 0, h - 1)[:, None, :, None], np.clip(vx, 0, w - 1)[None, :, None, :]]
        n = ok.sum(axis=(2, 3))
        sad = (np.abs(here - there) * ok).sum(axis=(2, 3))
        centre = ((cy + dy >= 0) & (cy + dy < h))[:, None] & ((cx + dx >= 0) & (cx + dx < w))[None, :]
        raw[k] = np.where(centre, np.where(n > 0, sad / np.maximum(n * 255.0, 1.0), 1.0), np.inf)
    dist = np.sqrt(np.array([dy * dy + dx * dx for dy, dx in steps], dtype=float))[:, None, None]
    win = np.argmin(raw + DISTANCE_PRIOR * dist, axis=0)  # first in scan order wins ties
    two = np.partition(raw, 1, axis=0)[:2]
    best, second = two[0], two[1]
    usable = np.isfinite(second) & (second > 1e-5)
    unique = np.where(usable, np.clip((second - best) / np.where(usable, second, 1.0), 0.0, 1.0), 0.0)
    conf = np.sqrt(unique * np.clip(1.0 - best * MATCH_SLOPE, 0.0, 1.0))
    s = np.array(steps, dtype=float)
    return s[win, 1], s[win, 0], conf


def block_match(gray: DataFrame, width: int, height: int, block: int = 8, radius: int = 6) -> DataFrame:
    """Block motion (clip_id, frame_no, gy, gx, vx, vy, confidence) of each frame against the one before.

    gray(v) at analysis resolution. Comparing (2r+1)^2 offsets as joined rows would multiply every
    cell by thousands; instead each pair of frame planes, bounded by the analysis size, is searched
    with array operations where it lies.
    """
    planes = long_to_planes(gray.select(*KEYS, "y", "x", F.col("v").cast("double").alias("v")), ["v"])
    pairs = planes.withColumnRenamed("v", "cur").join(shift_frames(planes).withColumnRenamed("v", "prev"), list(KEYS))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for clip, frame, cur, prev in b[["clip_id", "frame_no", "cur", "prev"]].itertuples(index=False):
                vx, vy, conf = _match_blocks(np.asarray(prev).reshape(height, width), np.asarray(cur).reshape(height, width), block, radius)
                gy, gx = np.indices(vx.shape)
                yield pd.DataFrame({"clip_id": clip, "frame_no": frame, "gy": gy.ravel(), "gx": gx.ravel(), "vx": vx.ravel(),
                                    "vy": vy.ravel(), "confidence": conf.ravel()})

    return pairs.select(*KEYS, "cur", "prev").mapInPandas(search, _BLOCKS)


def fill_low_confidence(grid: DataFrame, passes: int = 3) -> DataFrame:
    """Cells of low confidence inherit the weighted mean motion of their confident neighbours."""
    d = grid.select(*KEYS, F.col("gy").alias("y"), F.col("gx").alias("x"), "vx", "vy", "confidence")
    for i in range(passes):
        d = d.withColumn("_w", F.when(F.col("confidence") >= FILL_BELOW, F.col("confidence")).otherwise(0.0))
        n = neighbourhood(d, ["vx", "vy", "_w"], edge="null", exchange=i == 0)
        around = [F.col(f"n_{dy}_{dx}") for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        w = [F.coalesce(c["_w"], F.lit(0.0)) for c in around]
        n = n.select(*KEYS, "y", "x", "vx", "vy", "confidence", _sum(w).alias("sw"), F.greatest(*w).alias("mw"),
                     _sum([F.coalesce(c["vx"] * c["_w"], F.lit(0.0)) for c in around]).alias("sx"),
                     _sum([F.coalesce(c["vy"] * c["_w"], F.lit(0.0)) for c in around]).alias("sy"))
        fill = (F.col("confidence") < FILL_BELOW) & (F.col("sw") > 0)
        d = n.select(*KEYS, "y", "x", F.when(fill, F.col("sx") / F.col("sw")).otherwise(F.col("vx")).alias("vx"),
                     F.when(fill, F.col("sy") / F.col("sw")).otherwise(F.col("vy")).alias("vy"),
                     F.when(fill, F.col("mw") * FILL_SHARE).otherwise(F.col("confidence")).alias("confidence"))
    return d.select(*KEYS, F.col("y").alias("gy"), F.col("x").alias("gx"), "vx", "vy", "confidence")


def upsample_blocks(grid: DataFrame, cells: DataFrame, small_w: int, small_h: int, width: int, height: int, block: int = 8) -> DataFrame:
    """Block motion at analysis size to every full-resolution cell, in full-resolution pixels."""
    gw, gh = -(-small_w // block), -(-small_h // block)
    sx, sy = width / small_w, height / small_h
    q = cells.select(*KEYS, "y", "x").withColumn("_gx", ((F.col("x") + 0.5) / sx - 0.5 - block * 0.5) / block).withColumn(
        "_gy", ((F.col("y") + 0.5) / sy - 0.5 - block * 0.5) / block)
    src = grid.select(*KEYS, F.col("gy").alias("y"), F.col("gx").alias("x"), "vx", "vy", "confidence")
    out = sample_bilinear(q, src, {c: c for c in ("vx", "vy", "confidence")}, "_gx", "_gy", gw, gh)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*KEYS, "y", "x", zero(F.col("vx") * sx).alias("vx"), zero(F.col("vy") * sy).alias("vy"),
                      zero(clamp01(F.col("confidence"))).alias("confidence"))


def void_cuts(flow: DataFrame, segments: DataFrame) -> DataFrame:
    """Zero motion and zero confidence in every frame that starts a scene."""
    cut = segments.select(*KEYS, "cut")
    j = flow.join(cut, list(KEYS), "left")
    hit = F.coalesce(F.col("cut"), F.lit(False))
    fields = {c: F.when(hit, 0.0).otherwise(F.col(c)) for c in ("vx", "vy", "confidence")}
    return j.withColumns(fields).drop("cut")


# ---------------------------------------------------------------------------------------------


def bidirectional_confidence(flow: DataFrame, back: DataFrame, gray: DataFrame, width: int, height: int) -> DataFrame:
    """Photometric and forward/backward agreement of a flow, blurred inside the image.

    flow(vx, vy) current->previous, back(vx, vy) previous->current of the same pair (keyed to the
    current frame), gray(v). All lookups share the frame key, so cells move once.
    """
    d = flow.select(*KEYS, "y", "x", "vx", "vy").join(gray.select(*KEYS, "y", "x", F.col("v").alias("_v")), [*KEYS, "y", "x"])
    d = d.withColumn("_px", F.col("x") + F.col("vx")).withColumn("_py", F.col("y") + F.col("vy"))
    d = sample_bilinear(d, shift_frames(gray), {"v": "_pv"}, "_px", "_py", width, height)
    d = sample_bilinear(d, back, {"vx": "_bx", "vy": "_by"}, "_px", "_py", width, height)
    ok = inside(F.col("_px"), F.col("_py"), width, height) & F.col("_pv").isNotNull()
    d = d.withColumn("_ok", ok.cast("double")).withColumn(
        "_c", F.coalesce(F.exp(-F.abs(F.col("_v") - F.col("_pv")) / 24.0)
                         * F.exp(-hypot(F.col("vx") + F.col("_bx"), F.col("vy") + F.col("_by")) / 1.75), F.lit(0.0)) * F.col("_ok"))
    d = gauss3x3(d.select(*KEYS, "y", "x", "vx", "vy", "_ok", "_c"), "_c", name="_b", exchange=False)
    return d.select(*KEYS, "y", "x", "vx", "vy", clamp01(F.col("_b") * F.col("_ok")).alias("confidence"))


def zero_motion_confidence(gray: DataFrame) -> DataFrame:
    """Similarity of each cell to the same cell one frame earlier, blurred."""
    d = pair_previous(gray.select(*KEYS, "y", "x", "v"), ["v"]).where("prev_v IS NOT NULL").select(
        *KEYS, "y", "x", F.exp(-F.abs(F.col("v") - F.col("prev_v")) / 18.0).alias("_c"))
    return gauss3x3(d, "_c", name="_b").select(*KEYS, "y", "x", clamp01(F.col("_b")).alias("confidence"))


def zero_duplicate_frames(flow: DataFrame, gray: DataFrame, gates: DataFrame) -> DataFrame:
    """Frames gated as near duplicates get a zero field with similarity as confidence.

    gates(near_duplicate). Similarity is computed only for the gated frames.
    """
    dup = gates.where("near_duplicate").select(*KEYS)
    needed = gray.join(dup.select("clip_id", F.explode(F.array(F.col("frame_no"), F.col("frame_no") - 1)).alias("frame_no")).distinct(),
                       list(KEYS), "left_semi")
    z = zero_motion_confidence(needed).join(dup, list(KEYS), "left_semi").withColumnRenamed("confidence", "_zc")
    j = flow.join(z, [*KEYS, "y", "x"], "left")
    hit = F.col("_zc").isNotNull()
    return j.withColumns({"vx": F.when(hit, 0.0).otherwise(F.col("vx")), "vy": F.when(hit, 0.0).otherwise(F.col("vy")),
                          "confidence": F.coalesce("_zc", "confidence")}).drop("_zc")


def condition_outliers(flow: DataFrame) -> DataFrame:
    """Low-confidence vectors far from their 3x3 median are blended towards it."""
    d = median3x3(flow, ["vx", "vy"])
    mx, my, c = F.col("vx_med"), F.col("vy_med"), F.col("confidence")
    out = (c < 0.35) & (hypot(F.col("vx") - mx, F.col("vy") - my) > 0.75 + 0.25 * hypot(mx, my))
    b = F.when(out, clamp01((0.35 - c) / 0.35)).otherwise(0.0)
    d = d.withColumn("_b", b)
    b = F.col("_b")
    return d.withColumns({"vx": F.col("vx") * (1.0 - b) + mx * b, "vy": F.col("vy") * (1.0 - b) + my * b}).select(*flow.columns)


def import_external_motion(field: DataFrame, px: DataFrame, width: int, height: int, scale_x: float = 1.0, scale_y: float = 1.0,
                           flip_x: bool = False, flip_y: bool = False, direction: str = "current_to_previous",
                           segments: DataFrame | None = None) -> DataFrame:
    """Renderer motion files as a flow with photometric confidence.

    field(clip_id, frame_no = 1-based file position, y, x, mx, my). Forward files are read by the next
    frame and inverted; a void vector becomes zero with confidence 0, and so do cut frames.
    """
    m = import_motion(F.col("mx"), F.col("my"), scale_x, scale_y, flip_x, flip_y)
    lum = px.select(*KEYS, "y", "x", luma(F.col("r"), F.col("g"), F.col("b")).alias("_l"))
    if direction == "current_to_previous":
        f = field.select(*KEYS, "y", "x", m.alias("m")).select(*KEYS, "y", "x", "m.vx", "m.vy", F.col("m.valid").alias("_ok"))
    else:
        # A void forward vector must also void every inversion step that touches it.
        raw = field.select(*KEYS, "y", "x", m.alias("m")).select(
            *KEYS, "y", "x", F.when(F.col("m.valid"), F.col("m.vx")).otherwise(float("nan")).alias("vx"),
            F.when(F.col("m.valid"), F.col("m.vy")).otherwise(float("nan")).alias("vy"))
        f = invert_flow(shift_frames(raw), width, height).withColumnRenamed("valid", "_ok")
    d = lum.join(f, [*KEYS, "y", "x"], "left")
    d = d.withColumns({"vx": F.when(F.col("_ok"), F.col("vx")).otherwise(0.0), "vy": F.when(F.col("_ok"), F.col("vy")).otherwise(0.0)})
    d = d.withColumn("_px", F.col("x") + F.col("vx")).withColumn("_py", F.col("y") + F.col("vy"))
    d = sample_bilinear(d, shift_frames(lum), {"_l": "_pl"}, "_px", "_py", width, height, "reject")
    conf = clamp01(F.exp(-5.0 * F.abs(F.col("_l") - F.col("_pl")) / 255.0))
    ok = F.coalesce(F.col("_ok"), F.lit(False)) & F.col("_pl").isNotNull()
    out = d.select(*KEYS, "y", "x", "vx", "vy", F.when(ok, conf).otherwise(0.0).alias("confidence"))
    return out if segments is None else void_cuts(out, segments)


# Fixed values of cross-scale fusion, by mode.
FUSE = {
    "auto": dict(blend=0.42, coarse_min=0.72, protect=0.82, protect_unc=0.34, base=1.35, slope=0.10, damp=0.45),
    "strong": dict(blend=0.68, coarse_min=0.66, protect=0.90, protect_unc=0.28, base=0.95, slope=0.075, damp=0.72),
}


def fuse_coarse(full: DataFrame, coarse: DataFrame, width: int, height: int, coarse_w: int, coarse_h: int, mode: str = "auto",
                prior: float = 1.0) -> DataFrame:
    """Full-resolution flow with a coarser level as a second opinion.

    Both carry vx, vy, confidence, uncertainty. Agreement raises trust; disagreement blends towards
    the coarse vector unless the fine one is protected. Adds ``corrected`` and ``residual``.
    """
    k = FUSE[mode]
    sx, sy = width / coarse_w, height / coarse_h
    q = full.withColumn("_cx", (F.col("x") + 0.5) / sx - 0.5).withColumn("_cy", (F.col("y") + 0.5) / sy - 0.5)
    d = sample_bilinear(q, coarse, {"vx": "_vx", "vy": "_vy", "confidence": "_cc", "uncertainty": "_cu"}, "_cx", "_cy", coarse_w, coarse_h)
    d = d.withColumns({"_vx": F.col("_vx") * sx, "_vy": F.col("_vy") * sy, "_cc": clamp01(F.col("_cc")), "_cu": clamp01(F.col("_cu")),
                       "_fc": clamp01(F.col("confidence")), "_fu": clamp01(F.col("uncertainty"))})
    d = d.withColumns({"_res": hypot(F.col("vx") - F.col("_vx"), F.col("vy") - F.col("_vy")),
                       "_thr": k["base"] + k["slope"] * hypot(F.col("_vx"), F.col("_vy")),
                       "_on": finite(F.col("_vx")) & finite(F.col("_vy")) & (F.col("_cc") >= k["coarse_min"])})
    res, thr, fc, cc, fu, cu = (F.col(c) for c in ("_res", "_thr", "_fc", "_cc", "_fu", "_cu"))
    agree = F.col("_on") & (res <= thr)
    kept = (fc >= k["protect"]) & (fu < k["protect_unc"])
    if mode == "strong":
        kept = kept & (cc < fc + 0.06)
    severity = clamp01((res - thr) / F.greatest(F.lit(1.0), thr * 2.0))
    limit = k["blend"] * max(0.2, min(1.0, prior))
    d = d.withColumns({"_agree": agree, "_sev": severity})
    blend = (limit * (0.25 + 0.75 * F.col("_sev")) * (0.55 + 0.45 * cc) * (0.72 + 0.28 * fu)
             * F.when(fc > 0.75, k["damp"]).otherwise(1.0))
    d = d.withColumn("_bl", F.when(F.col("_on") & ~F.col("_agree") & ~kept, blend).otherwise(0.0))
    d = d.withColumn("corrected", F.col("_bl") >= 0.03)
    hit, b = F.col("corrected"), F.col("_bl")
    agreement = clamp01(1.0 - res / F.greatest(F.lit(0.5), thr))
    conf = (F.when(F.col("_agree"), F.greatest(F.col("confidence"), F.least(F.lit(0.94), 0.65 * fc + 0.35 * cc)))
            .when(hit, F.greatest(fc, F.least(F.lit(0.90), 0.58 * fc + 0.42 * cc))).otherwise(F.col("confidence")))
    unc = (F.when(F.col("_agree"), clamp01((0.62 * F.col("uncertainty") + 0.38 * cu) * (1.0 - 0.28 * agreement)))
           .when(hit, clamp01(0.46 * fu + 0.29 * cu + 0.25 * F.col("_sev"))).otherwise(F.col("uncertainty")))
    return d.withColumns({"_nc": conf, "_nu": unc}).withColumns({
        "vx": F.when(hit, F.col("vx") + (F.col("_vx") - F.col("vx")) * b).otherwise(F.col("vx")),
        "vy": F.when(hit, F.col("vy") + (F.col("_vy") - F.col("vy")) * b).otherwise(F.col("vy")),
        "confidence": F.col("_nc"), "uncertainty": F.col("_nu"), "residual": F.when(hit, res)}).select(
        *full.columns, "corrected", "residual")


def fusion_diagnostics(fused: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Corrected share and mean residual per frame, combined with those of an earlier scale."""
    d = fused.groupBy(*KEYS).agg(F.avg(F.col("corrected").cast("double")).alias("f"),
                                 F.coalesce(F.avg("residual"), F.lit(0.0)).alias("r"))
    if earlier is None:
        return d.select(*KEYS, F.col("f").alias("corrected_fraction"), F.col("r").alias("mean_residual"))
    e = earlier.select(*KEYS, clamp01(F.col("corrected_fraction")).alias("pf"), F.col("mean_residual").alias("pr"))
    j = d.join(e, list(KEYS), "left").withColumns({"pf": F.coalesce("pf", F.lit(0.0)), "pr": F.coalesce("pr", F.lit(0.0))})
    w = F.col("pf") + F.col("f")
    return j.select(*KEYS, (1.0 - (1.0 - F.col("pf")) * (1.0 - F.col("f"))).alias("corrected_fraction"),
                    F.when(w > 1e-6, (F.col("pr") * F.col("pf") + F.col("r") * F.col("f")) / w).otherwise(0.0).alias("mean_residual"))
