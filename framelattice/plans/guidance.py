"""Compositions: from frames and packed motion to the fields two kinds of consumer read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import KEYS, stored
from ..operators import motion as M
from ..operators import pairs as P
from ..operators import reliability as R
from ..operators import scans as S
from ..operators import telemetry as T


@dataclass(frozen=True)
class Guidance:
    analysis: DataFrame  # fused field with raw vectors and reliability
    conservative: DataFrame  # bounded correction and history confidence
    aggressive: DataFrame  # repaired field, then trajectory consensus (planes)
    segments: DataFrame


def guidance_paths(analysis: DataFrame, segments: DataFrame, width: int, height: int, mode: str = "auto", step: int = 4,
                   depth: DataFrame | None = None, stride: int = 1) -> Guidance:
    """Two policies from one analysis.

    analysis(vx, vy, raw_vx, raw_vy, confidence, visibility, disocclusion, occlusion, uncertainty). Both
    policies vote over the same repaired field, so it is built once: the aggressive path keeps it, the
    conservative path only steps towards it. The consensus of the aggressive path also sees the depth and the camera motion; frames
    without a camera fit count as still. What several consumers read is written once, at once: segments, the field with its depth, the camera
    and the repaired field. Else each consumer would run the estimator, the scene detection, the fit and the repair anew.
    """
    segments = stored(segments, "segments")
    fields = analysis.join(segments.select(*KEYS, F.col("cut").alias("_cut")), list(KEYS))
    if depth is not None:
        fields = fields.join(depth.select(*KEYS, "y", "x", "d"), [*KEYS, "y", "x"], "left")
    fields = stored(fields, "fields")
    live, dead = fields.where("NOT _cut").drop("_cut"), fields.where("_cut").drop("_cut")
    model = stored(R.fit_affine_motion(live, width, height, mode, stride), "camera")
    repaired = stored(R.with_repair(live, width, height, mode, step, None if depth is None else "d", model), "repaired")
    # nothing is corrected across a cut
    safe = R.safe_policy(repaired, analysis.columns, width, height, mode)
    safe = safe.unionByName(dead.select(*analysis.columns).withColumns({"corrected": F.lit(False), "rejected": F.lit(True)}))
    strong = repaired.drop("repaired", "_u0").unionByName(dead)
    fields = ["vx", "vy", "confidence", "visibility", "uncertainty", "disocclusion"]
    if depth is not None:
        strong = strong.withColumn("d", F.coalesce("d", F.lit(0.0)))
        fields.append("d")
    planes = S.scene_planes(strong.select(*KEYS, "y", "x", *fields), fields, segments)
    camera = model.select(*KEYS, F.array("vx0").alias("global_x"), F.array("vy0").alias("global_y"))
    still = F.array(F.lit(0.0))
    planes = planes.join(camera, list(KEYS), "left").withColumns({c: F.coalesce(c, still) for c in ("global_x", "global_y")})
    aggressive = S.trajectory_consensus(planes, width, height, mode, step, has_depth=depth is not None, has_global=True)
    return Guidance(analysis, safe, aggressive, segments)


def analyse(px: DataFrame, grid: DataFrame, segments: DataFrame, width: int, height: int, grid_w: int, grid_h: int) -> DataFrame:
    """Grid motion with all evidence, void across cuts."""
    return R.grid_reliability(grid, px, width, height, grid_w, grid_h, segments=segments)


def segment_scenes(px: DataFrame, width: int, height: int, threshold: float = 0.28, analysis_width: int | None = None) -> DataFrame:
    return P.scene_segments(P.scene_cut_score(P.gray_cells(px, "resampled", width, height, analysis_width)), threshold)


def block_flow(px: DataFrame, segments: DataFrame, width: int, height: int, analysis_width: int | None = None, block: int = 8,
               radius: int = 6) -> DataFrame:
    """The native estimator from frames to a dense field."""
    w, h = (width, height) if analysis_width is None else P.analysis_size(width, height, analysis_width)
    g = P.gray_cells(px, "resampled", width, height, analysis_width)
    grid = M.fill_low_confidence(M.block_match(g, w, h, block, radius))
    return M.void_cuts(M.upsample_blocks(grid, px, w, h, width, height, block), segments)


def telemetry(g: Guidance) -> DataFrame:
    """One row per frame of the conservative path's telemetry."""
    roll = T.temporal_rollup(g.conservative)
    scores = g.segments.select(*KEYS, F.col("score").alias("scene_score"), F.col("cut").cast("int").alias("scene_cut"))
    cons = g.aggressive.select(*KEYS, F.col("corrected_fraction").alias("temporal_consensus_fraction"),
                               F.col("mean_residual").alias("temporal_consensus_residual"), F.col("history").alias("temporal_consensus_history"))
    return scores.join(roll, list(KEYS)).join(R.safe_diagnostics(g.conservative), list(KEYS)).join(cons, list(KEYS))
