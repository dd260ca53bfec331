"""Queries over whole guidance compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..operators.pairs import scene_segments
from ..sources import fixtures as fx
from ..sources.fields import planes_to_long
from ..sources.fixtures import with_fixtures
from . import guidance as G
from .q_pairs import CUT, WGRAY_CTE, cut_sql, scores
from .q_reliability import repair_sql, safe_sql
from .registry import query
from .sqltext import on

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"


def _guidance(spark, d):
    f = fx.wide_flow(spark, d).withColumns({"raw_vx": F.col("vx"), "raw_vy": F.col("vy")})
    return G.guidance_paths(f, scene_segments(scores(spark, d, wide=True), CUT), 48, 32, "auto", 4, fx.wide_depth(spark, d))


@query("e13_guidance_conservative", with_fixtures("wflow", "wdepth", "wpx") + "," + WGRAY_CTE + "," + cut_sql("gray") + "," + repair_sql("auto", 4, True)
       + "," + safe_sql("auto") + f""" SELECT f.clip_id, f.frame_no, f.y, f.x, round(CASE WHEN g.cut THEN f.vx ELSE s.vx END,5)+0e0 AS vx,
 round(CASE WHEN g.cut THEN f.vy ELSE s.vy END,5)+0e0 AS vy, round(CASE WHEN g.cut THEN f.confidence ELSE s.hc END,5) AS confidence
 FROM wflow f JOIN safe s ON {on('s', 'f', ('clip_id', 'frame_no', 'y', 'x'))} JOIN segments g ON {on('g', 'f')}""")
def conservative(spark, d):
    return _guidance(spark, d).conservative.select(*CELL, *[r6(F.col(c), 5).alias(c) for c in ("vx", "vy", "confidence")])


@query("e13_guidance_aggressive")
def aggressive(spark, d):
    out = planes_to_long(_guidance(spark, d).aggressive, ["vx", "vy", "confidence"], 48)
    return out.select(*CELL, *[r6(F.col(c), 5).alias(c) for c in ("vx", "vy", "confidence")])


@query("e13_guidance_telemetry")
def guidance_telemetry(spark, d):
    t = G.telemetry(_guidance(spark, d))
    return t.select(*["clip_id", "frame_no", "scene_cut"], *[r6(F.col(c), 5).alias(c) for c in t.columns if c not in ("clip_id", "frame_no", "scene_cut")])
