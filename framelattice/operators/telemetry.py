"""Per-frame telemetry, its rollups, output timelines and rate limiting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import KEYS, big, clamp01, frac, hypot

# The stages a frame passes, in order.
STAGES = ("decode_ms", "flow_ms", "denoise_ms", "depth_ms", "depth_stabilize_ms", "motion_consensus_ms", "neural_ms",
          "output_stabilize_ms", "encode_ms", "total_ms")


def temporal_rollup(flow: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """Per frame means of motion, confidence and visibility and three risk shares.

    One map-side combined aggregation; an absent optional field falls back to its default.
    """
    def opt(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in flow.columns else F.lit(default)

    out = flow.groupBy(*KEYS).agg(
        F.avg(hypot(F.col("vx"), F.col("vy"))).alias("avg_mv_px"), F.avg("confidence").alias("avg_confidence"),
        F.avg(opt("visibility", 1.0)).alias("mean_history_visibility"),
        frac(opt("disocclusion", 0.0) >= 0.5).alias("disoccluded_fraction"),
        frac(opt("occlusion", 0.0) >= 0.5).alias("occlusion_ambiguous_fraction"),
        frac(opt("uncertainty", 0.0) >= 0.65).alias("high_uncertainty_fraction"))
    return out if diagnostics is None else out.join(diagnostics, list(KEYS), "left")


def stage_rollup(stage_log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean milliseconds per stage and frames per second of the whole, per clip or overall."""
    stages = [s for s in STAGES if s in stage_log.columns]
    d = stage_log.groupBy(*by) if by else stage_log.groupBy()
    return d.agg(F.count(F.lit(1)).alias("frames"), *[F.avg(s).alias(f"avg_{s}") for s in stages],
                 F.when(F.sum("total_ms") > 0, 1000.0 * F.count(F.lit(1)) / F.sum("total_ms")).otherwise(0.0).alias("pipeline_fps"))


def running(frames: DataFrame, sums: dict[str, str], block: int = 4096) -> DataFrame:
    """Adds running sums over each clip's frames: {name: column}.

    On two levels, so that a long clip is many tasks: frames are summed within blocks of their number, and what the blocks before sum to (one
    row a block) is added.
    """
    d = frames.withColumn("_block", F.floor(F.col("frame_no") / block))
    totals = d.groupBy("clip_id", "_block").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = W.partitionBy("clip_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("clip_id", "_block", *[F.sum(f"_{k}").over(before).alias(f"_{k}") for k in sums])
    within = W.partitionBy("clip_id", "_block").orderBy("frame_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumns({k: F.sum(c).over(within) for k, c in sums.items()}).join(totals, ["clip_id", "_block"])
    return d.withColumns({k: F.coalesce(F.col(f"_{k}"), F.lit(0)) + F.col(k) for k in sums}).drop("_block", *[f"_{k}" for k in sums])


def progress(frames: DataFrame, total: str | None = "total_frames", duration: str | None = None, rate: str = "fps_in") -> DataFrame:
    """Running speed, completed fraction and remaining seconds per clip.

    frames(clip_id, frame_no, total_ms[, total_frames][, duration seconds, source frame rate]). Without a frame count the fraction
    comes from the duration, and no time is estimated.
    """
    d = running(frames.withColumn("_one", F.lit(1)), {"done": "_one", "_ms": "total_ms"}).withColumn("elapsed_s", F.col("_ms") / 1000.0).drop("_one", "_ms")
    d = d.withColumn("fps", F.when(F.col("elapsed_s") > 0.001, F.col("done") / F.col("elapsed_s")).otherwise(0.0))
    n = F.col(total) if total else F.lit(None).cast("bigint")
    by_time = F.when(F.col(duration) > 0, clamp01(F.col("done") / F.col(rate) / F.col(duration))) if duration else F.lit(None).cast("double")
    return d.withColumn("fraction", F.when(n > 0, clamp01(F.col("done") / n)).otherwise(by_time)).withColumn(
        "eta_s", F.when(n > 0, F.when(F.col("fps") > 0.01, F.greatest(n - F.col("done"), F.lit(0)) / F.col("fps")).otherwise(0.0)))


def effective_multiplier(enabled: bool, multiplier: int) -> int:
    if enabled and not 2 <= multiplier <= 6:
        raise ValueError("the multiplier is 2 to 6")
    return multiplier if enabled else 1


def expand_timeline(frames: DataFrame, multiplier: int, enabled: bool = True, fps: Column | None = None) -> DataFrame:
    """Output slots of N source frames at ``multiplier`` times the rate: exactly N * multiplier.

    frames(clip_id, frame_no 1..N, cut). The first frame is one real slot; each later one is
    multiplier-1 generated slots (the previous real frame again after a cut) and a real one; the last
    frame is repeated to keep the duration. Slot numbers are arithmetic, so nothing is ranked.
    """
    m = effective_multiplier(enabled, multiplier)
    last = F.lead("frame_no").over(W.partitionBy("clip_id").orderBy("frame_no")).isNull()
    f = F.col("frame_no")
    slots = F.sequence(F.lit(1), F.when(F.col("_last"), 2 * m - 1).otherwise(m))
    d = frames.withColumn("_last", last).select("*", F.explode(slots).alias("slot")).where((f > 1) | (F.col("slot") >= m))
    slot = F.col("slot")
    kind = (F.when(slot > m, "duplicate").when(slot == m, "real").when(F.col("cut"), "fallback").otherwise("generated"))
    out = d.select(
        "clip_id", f.alias("frame_no"), big(1 + (f - 2) * m + slot).alias("output_index"), kind.alias("kind"),
        F.when(kind == "fallback", f - 1).otherwise(f).alias("source_frame"),
        F.when(kind == "generated", slot / F.lit(float(m))).alias("phase"))
    return out if fps is None else out.withColumn("output_ts", (F.col("output_index") - 1) / (fps * m))


def fg_rollup(timeline: DataFrame) -> DataFrame:
    """Per real frame: was it generated or filled, and output frames so far."""
    per = timeline.where("kind <> 'duplicate'").groupBy(*KEYS).agg(
        F.count_if(F.col("kind") == "generated").alias("generated"), F.count_if(F.col("kind") == "fallback").alias("fallback"),
        F.count(F.lit(1)).alias("slots"))
    w = W.partitionBy("clip_id").orderBy("frame_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.withColumn("output_frames", big(F.sum("slots").over(w))).drop("slots")


def fg_totals(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("clip_id").agg(
        F.count_if(F.col("kind") == "generated").alias("generated"), F.count_if(F.col("kind") == "fallback").alias("fallback"),
        F.count_if(F.col("kind") == "real").alias("real_frames"), F.count(F.lit(1)).alias("output_frames"))


def compare_runs(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """Two telemetry runs frame by frame; frames only one run has keep a null delta."""
    left = a.select(*KEYS, *[F.col(m).alias(f"{m}_a") for m in metrics], F.lit(True).alias("_a"))
    right = b.select(*KEYS, *[F.col(m).alias(f"{m}_b") for m in metrics], F.lit(True).alias("_b"))
    j = left.join(right, list(KEYS), "full_outer")
    side = F.when(F.col("_a").isNull(), "b").when(F.col("_b").isNull(), "a").otherwise("both")
    return j.select(*KEYS, side.alias("present"), *[c for m in metrics for c in (
        F.col(f"{m}_a"), F.col(f"{m}_b"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta"))])


# ---------------------------------------------------------------------------------------------


def rate_limit_buckets(df: DataFrame, key: str, ts: str, interval_s: float) -> DataFrame:
    """First row of each fixed time bucket: the cheap, order-free variant."""
    bucket = F.floor(F.col(ts) / interval_s)
    return df.groupBy(key, big(bucket).alias("bucket")).agg(F.min(ts).alias(ts))


def rate_limit(df: DataFrame, key: str, ts: str, interval_s: float) -> DataFrame:
    """Rows at least ``interval_s`` after the last kept row of their key; ts in seconds.

    After a pause of a whole interval a row is kept whatever came before, so the scan unit is the run
    of rows between such pauses, not the key.
    """
    w = W.partitionBy(key).orderBy(ts)
    gap = F.col(ts) - F.lag(ts).over(w)
    d = df.select(key, ts).withColumn("_start", F.when(gap.isNull() | (gap >= interval_s), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    d = d.select(key, "_run", ts).repartition(key, "_run").sortWithinPartitions(key, "_run", ts)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried, last = None, -np.inf  # the run a batch ended in, and its last kept time
        for b in batches:
            if b.empty:
                continue
            t, runs = b[ts].to_numpy(), b[[key, "_run"]].to_numpy()
            cuts = np.flatnonzero((runs[1:] != runs[:-1]).any(axis=1)) + 1
            picked = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(t)]):
                run = tuple(runs[lo])
                if run != carried:
                    carried, last = run, -np.inf
                i = int(lo)
                while True:
                    i += int(np.searchsorted(t[i:hi], last + interval_s, "left"))
                    if i >= hi:
                        break
                    picked.append(i)
                    last = t[i]
                    i += 1
            yield b.iloc[picked][[key, ts]]

    return d.mapInPandas(keep, df.select(key, ts).schema)
