"""Frame-pair statistics: scene cuts, segments, informative pairs, flow quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import KEYS, big, clamp01, finite, frac, hypot
from ..functions.colour import luma, luma8
from .lattice import pair_previous, resample_nearest

# Histogram bins, the two shares of the cut score, and analysis limits.
BINS = 32
HIST_SHARE, MAD_SHARE = 0.65, 0.35
MIN_ANALYSIS_WIDTH = 64


def analysis_size(width: int, height: int, analysis_width: int) -> tuple[int, int]:
    w = min(max(analysis_width, MIN_ANALYSIS_WIDTH), width) if width >= MIN_ANALYSIS_WIDTH else width
    return w, max(1, int(height * w / width + 0.5))


def gray_cells(px: DataFrame, variant: str, width: int, height: int, analysis_width: int | None = None) -> DataFrame:
    """Luma ``v`` of the cells a cut score looks at.

    resampled: rounded luma, at ``analysis_width`` if one is given; every4: unrounded luma of every fourth pixel in both
    directions; gray: an already gray ``v`` column, untouched.
    """
    if variant == "gray":
        return px.select(*KEYS, "y", "x", "v")
    rgb = [F.col(c) for c in "rgb"]
    if variant == "every4":
        return px.where((F.col("y") % 4 == 0) & (F.col("x") % 4 == 0)).select(*KEYS, "y", "x", luma(*rgb).alias("v"))
    if variant != "resampled":
        raise ValueError(f"unknown cut variant {variant!r}")
    w, h = (width, height) if analysis_width is None else analysis_size(width, height, analysis_width)
    d = px.select(*KEYS, "y", "x", "r", "g", "b")
    if (w, h) != (width, height):
        d = resample_nearest(d, width, height, w, h)
    return d.select(*KEYS, "y", "x", luma8(*rgb).alias("v"))


def scene_cut_score(gray: DataFrame, first_score: float = 1.0) -> DataFrame:
    """Per frame: .65 * half histogram L1 + .35 * mean absolute difference / 255, against frame N-1.

    One lag per cell pairs the frames; each pair adds +1 and -1 to two histogram bins, so both terms
    come out of the same map-side combined aggregation. A frame without a predecessor scores
    ``first_score``, one whose predecessor has another size scores 1.
    """
    d = pair_previous(gray, ["v"])
    bin_of = lambda c: F.least(F.lit(BINS - 1), F.floor(c * BINS / 256.0)).cast("int")
    def entry(*vals) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(vals, ("bin", "delta", "ad", "cells", "paired"))])

    paired = F.col("prev_v").isNotNull()
    ad = F.coalesce(F.abs(F.col("v") - F.col("prev_v")).cast("double"), F.lit(0.0))
    cur = entry(bin_of(F.col("v")), F.lit(1), ad, F.lit(1), paired.cast("int"))
    prev = entry(bin_of(F.coalesce("prev_v", F.lit(0))), F.lit(-1), F.lit(0.0), F.lit(0), F.lit(0))
    d = d.select(*KEYS, F.explode(F.when(F.col("prev_v").isNull(), F.array(cur)).otherwise(F.array(cur, prev))).alias("s")).select(*KEYS, "s.*")
    bins = d.groupBy(*KEYS, "bin").agg(F.sum("delta").alias("delta"), F.sum("ad").alias("ad"), F.sum("cells").alias("cells"),
                                       F.sum("paired").alias("paired"))
    per = bins.groupBy(*KEYS).agg(F.sum(F.abs("delta")).alias("l1"), F.sum("ad").alias("ad"), F.sum("cells").alias("cells"),
                                  F.sum("paired").alias("paired"))
    w = W.partitionBy("clip_id").orderBy("frame_no")
    per = per.withColumn("_p", F.lag(F.struct("frame_no", "cells")).over(w))
    first = F.coalesce(F.col("_p.frame_no") != F.col("frame_no") - 1, F.lit(True))
    same = (F.col("paired") == F.col("cells")) & (F.col("_p.cells") == F.col("cells"))
    hist = F.col("l1") / F.col("cells") * 0.5
    mad = F.col("ad") / F.col("cells") / 255.0
    score = F.when(first, F.lit(first_score)).when(~same, 1.0).otherwise(clamp01(hist * HIST_SHARE + mad * MAD_SHARE))
    return per.select(*KEYS, first.alias("is_first"), score.alias("score"),
                      F.when(~first & same, hist).alias("hist"), F.when(~first & same, mad).alias("mad"))


def rgb_l1_score(px: DataFrame, step: int = 1) -> DataFrame:
    """Per frame: mean absolute RGB difference / 255 of every step-th pixel both ways; first frame 1."""
    d = px if step == 1 else px.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    d = d.select(*KEYS, "y", "x", "r", "g", "b")
    d = pair_previous(d, ["r", "g", "b"])
    diff = sum((F.abs(F.col(c) - F.col(f"prev_{c}")) for c in "rgb"), F.lit(0))
    return d.groupBy(*KEYS).agg(F.coalesce(F.avg(diff / 3.0) / 255.0, F.lit(1.0)).alias("score"),
                                (F.count("prev_r") == 0).alias("is_first"))


def scene_segments(scores: DataFrame, threshold: float, clamp_threshold: bool = True) -> DataFrame:
    """Cut flags and running scene numbers per clip."""
    t = min(0.95, max(0.05, threshold)) if clamp_threshold else threshold
    w = W.partitionBy("clip_id").orderBy("frame_no")
    cut = F.col("is_first") | (F.col("score") >= t)
    return scores.withColumn("cut", cut).withColumn(
        "scene_id", big(F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))))


def pair_mad(px: DataFrame) -> DataFrame:
    """Mean absolute luma difference / 255 per frame with a predecessor."""
    d = px.select(*KEYS, "y", "x", luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    d = pair_previous(d, ["l"]).where("prev_l IS NOT NULL")
    return d.groupBy(*KEYS).agg((F.sum(F.abs(F.col("l") - F.col("prev_l"))) / 255.0 / F.count(F.lit(1))).alias("mad"))


def informative_pairs(mads: DataFrame, k: int = 6, lo: float = 0.003, hi: float = 0.55, first_frames: int | None = None) -> DataFrame:
    """The k most different usable pairs of a clip, or of its first frames if so asked; ties (to 1e-9) keep the earlier frame."""
    use = mads.where((F.col("mad") >= lo) & (F.col("mad") <= hi))
    use = use if first_frames is None else use.where(F.col("frame_no") <= first_frames)
    w = W.partitionBy("clip_id").orderBy(F.desc(F.round("mad", 9)), "frame_no")
    return use.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", big("rank"))


def minmax_normalize(depth: DataFrame, value: str = "d", keys=KEYS) -> DataFrame:
    """Per frame finite minimum and maximum to [0, 1]; a flat frame is 0, non-finite cells take the minimum."""
    v = F.col(value)
    f = F.when(finite(v), v)
    # Two values a frame, joined back: no frame is held together.
    d = depth.join(depth.groupBy(*keys).agg(F.min(f).alias("_lo"), F.max(f).alias("_hi")), list(keys))
    lo, hi = F.col("_lo"), F.col("_hi")
    flat = lo.isNull() | (hi - lo < 1e-12)
    x = F.when(finite(v), v).otherwise(lo)
    return d.withColumn(value, F.when(flat, 0.0).otherwise(clamp01((x - lo) / (hi - lo)))).drop("_lo", "_hi")


def flow_stats(flow: DataFrame, gray: DataFrame) -> DataFrame:
    """Per frame quality of a flow and change of the gray image under it.

    flow(vx, vy, confidence), gray(v). Quantiles are exact; a group is one frame.
    """
    d = pair_previous(gray, ["v"]).where("prev_v IS NOT NULL").select(
        *KEYS, "y", "x", F.abs(F.col("v") - F.col("prev_v")).alias("ad"))
    j = flow.select(*KEYS, "y", "x", hypot(F.col("vx"), F.col("vy")).alias("mag"), "confidence").join(d, [*KEYS, "y", "x"])
    q = F.percentile("mag", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return j.groupBy(*KEYS).agg(
        q.alias("_q"), F.avg("confidence").alias("mean_conf"), frac(F.col("confidence") < 0.25).alias("bad_ratio"),
        (F.avg("ad") / 255.0).alias("mad"), frac(F.col("ad") > 8).alias("changed_ratio"),
    ).select(*KEYS, F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p90"), F.col("_q")[2].alias("p95"),
             "mean_conf", "bad_ratio", "mad", "changed_ratio")


def candidate_score(s=F.col) -> Column:
    return s("mean_conf") - 0.12 * s("bad_ratio")


def needs_rescue(s=F.col) -> Column:
    return (s("mean_conf") < 0.78) | (s("bad_ratio") > 0.18) | ((s("p95") > 24.0) & (s("mean_conf") < 0.90))


def near_duplicate(s=F.col) -> Column:
    return (s("mad") < 0.010) & (s("changed_ratio") < 0.020) & (s("p50") < 0.12) & (s("p95") < 1.50)


def stability_gates(stats: DataFrame) -> DataFrame:
    return stats.select(*KEYS, candidate_score().alias("candidate_score"), needs_rescue().alias("needs_rescue"),
                        near_duplicate().alias("near_duplicate"))


def choose_candidate(primary: DataFrame, alternate: DataFrame, margin: float = 0.005) -> DataFrame:
    """Per frame, whether the alternate field replaces the primary one (stats tables in)."""
    a = primary.select(*KEYS, candidate_score().alias("primary_score"), needs_rescue().alias("tried"))
    b = alternate.select(*KEYS, candidate_score().alias("alternate_score"))
    j = a.join(b, list(KEYS), "left")
    use = F.col("tried") & F.coalesce(F.col("alternate_score") > F.col("primary_score") + margin, F.lit(False))
    return j.withColumn("use_alternate", use)


def select_field(choice: DataFrame, primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Cells of the chosen field per frame.

    Two filtered reads and a union, so the rejected field's cells stop at a semi join on the frame key.
    """
    keep = choice.where("NOT use_alternate").select(*KEYS)
    swap = choice.where("use_alternate").select(*KEYS)
    return primary.join(keep, list(KEYS), "left_semi").unionByName(alternate.join(swap, list(KEYS), "left_semi"))
