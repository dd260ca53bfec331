"""Queries over telemetry rollups, timelines, rate limiting and repeated passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import big, r6
from ..functions import colour as K
from ..operators import lattice as L
from ..operators import telemetry as T
from ..operators.iterate import iterate_passes
from ..operators.pairs import scene_segments
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .q_lattice import _EDGE_W
from .q_pairs import CUT, GRAY_CTE, cut_sql, scores
from .registry import query
from .sqltext import nine_join, on

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"
_R = ["avg_mv_px", "avg_confidence", "mean_history_visibility", "disoccluded_fraction", "occlusion_ambiguous_fraction", "high_uncertainty_fraction"]


@query("d14_temporal_rollup", with_fixtures("wflow") + """
SELECT clip_id, frame_no, round(avg(sqrt(vx*vx+vy*vy)),6) AS avg_mv_px, round(avg(confidence),12) AS avg_confidence, round(avg(visibility),12) AS mean_history_visibility,
 round(avg(CASE WHEN disocclusion>=.5e0 THEN 1e0 ELSE 0e0 END),6) AS disoccluded_fraction, round(avg(CASE WHEN occlusion>=.5e0 THEN 1e0 ELSE 0e0 END),6) AS occlusion_ambiguous_fraction,
 round(avg(CASE WHEN uncertainty>=.65e0 THEN 1e0 ELSE 0e0 END),6) AS high_uncertainty_fraction FROM wflow GROUP BY 1,2""")
def temporal_rollup(spark, d):
    r = T.temporal_rollup(fx.wide_flow(spark, d))
    return r.select("clip_id", "frame_no", *[r6(F.col(c), 12 if c in _R[1:3] else 6).alias(c) for c in _R])


def stage_log(spark, d):
    return fx.stage(spark, d).withColumn("total_ms", F.col("decode_ms") + F.col("flow_ms") + F.col("denoise_ms"))


@query("d15_stage_rollup", with_fixtures("stage") + """
SELECT clip_id, count(*) AS frames, round(avg(decode_ms),6) AS avg_decode_ms, round(avg(flow_ms),6) AS avg_flow_ms, round(avg(denoise_ms),6) AS avg_denoise_ms,
 round(avg(decode_ms+flow_ms+denoise_ms),6) AS avg_total_ms, round(1000e0*count(*)/sum(decode_ms+flow_ms+denoise_ms),6) AS pipeline_fps FROM stage GROUP BY 1""")
def stage_rollup(spark, d):
    r = T.stage_rollup(stage_log(spark, d), ["clip_id"])
    return r.select("clip_id", "frames", *[r6(F.col(c)).alias(c) for c in r.columns if c.startswith("avg_") or c == "pipeline_fps"])


@query("d15_stage_rollup_total", with_fixtures("stage") + """
SELECT count(*) AS frames, round(avg(decode_ms),6) AS avg_decode_ms, round(avg(flow_ms),6) AS avg_flow_ms, round(avg(denoise_ms),6) AS avg_denoise_ms,
 round(avg(decode_ms+flow_ms+denoise_ms),6) AS avg_total_ms, round(1000e0*count(*)/sum(decode_ms+flow_ms+denoise_ms),6) AS pipeline_fps FROM stage""")
def stage_rollup_total(spark, d):
    r = T.stage_rollup(stage_log(spark, d))
    return r.select("frames", *[r6(F.col(c)).alias(c) for c in r.columns if c != "frames"])


PROGRESS_SQL = with_fixtures("stage") + """,
w AS (SELECT clip_id, frame_no, count(*) OVER o AS done, sum(decode_ms+flow_ms+denoise_ms) OVER o / 1000e0 AS e, count(*) OVER (PARTITION BY clip_id)+5 AS n
  FROM stage WINDOW o AS (PARTITION BY clip_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN e>.001e0 THEN done/e ELSE 0e0 END AS fps FROM w)
SELECT clip_id, frame_no, done, round(e,6) AS elapsed_s, round(fps,6) AS fps, round(least(done/CAST(n AS DOUBLE),1e0),6) AS fraction,
 floor(CASE WHEN fps>.01e0 THEN greatest(n-done,0)/fps ELSE 0e0 END*1e6+.5e0)/1e6 AS eta_s FROM s"""


@query("d16_progress", PROGRESS_SQL)
def progress(spark, d):
    s = stage_log(spark, d)
    total = s.groupBy("clip_id").agg((F.count(F.lit(1)) + 5).alias("total_frames"))
    p = T.progress(s.join(total, "clip_id"))
    return p.select("clip_id", "frame_no", "done", *[r6(F.col(c)).alias(c) for c in ("elapsed_s", "fps", "fraction")],
                    (F.floor(F.col("eta_s") * 1e6 + 0.5) / 1e6).alias("eta_s"))


@query("d16_progress_by_duration", with_fixtures("stage") + """,
w AS (SELECT clip_id, frame_no, count(*) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS done FROM stage)
SELECT clip_id, frame_no, done, round(least(done/24e0/(40e0+clip_id),1e0),6) AS fraction FROM w""")
def progress_by_duration(spark, d):
    """Clips whose frame count is unknown: seconds and frame rate of the source instead."""
    s = stage_log(spark, d).withColumn("seconds", 40.0 + F.col("clip_id")).withColumn("fps_in", F.lit(24.0))
    return T.progress(s, None, "seconds").select("clip_id", "frame_no", "done", r6(F.col("fraction")).alias("fraction"))


_TIMELINE = GRAY_CTE + "," + cut_sql("gray") + """,
tl AS (SELECT s.clip_id, s.frame_no, 1+(s.frame_no-2)*3+sl AS output_index, CASE WHEN sl>3 THEN 'duplicate' WHEN sl=3 THEN 'real' WHEN s.cut THEN 'fallback' ELSE 'generated' END AS kind, sl
  FROM segments s CROSS JOIN (SELECT i+1 AS sl FROM range(5) t(i)) k WHERE (s.frame_no>1 OR sl>=3) AND (sl<=3 OR s.frame_no=6))"""


def timeline(spark, d):
    return T.expand_timeline(scene_segments(scores(spark, d), CUT), 3)


@query("f07_expand_timeline", with_fixtures("px") + "," + _TIMELINE + """
SELECT clip_id, frame_no, output_index, kind, CASE WHEN kind='fallback' THEN frame_no-1 ELSE frame_no END AS source_frame,
 CASE WHEN kind='generated' THEN round(sl/3e0,6) END AS phase FROM tl""")
def expand_timeline(spark, d):
    return timeline(spark, d).withColumn("phase", r6(F.col("phase")))


@query("d17_fg_rollup", with_fixtures("px") + "," + _TIMELINE + """,
p AS (SELECT clip_id, frame_no, count(*) FILTER (WHERE kind='generated') AS generated, count(*) FILTER (WHERE kind='fallback') AS fallback, count(*) AS s
  FROM tl WHERE kind<>'duplicate' GROUP BY 1,2)
SELECT clip_id, frame_no, generated, fallback, CAST(sum(s) OVER (PARTITION BY clip_id ORDER BY frame_no) AS BIGINT) AS output_frames FROM p""")
def fg_rollup(spark, d):
    return T.fg_rollup(timeline(spark, d))


@query("d17_fg_totals", with_fixtures("px") + "," + _TIMELINE + """
SELECT clip_id, count(*) FILTER (WHERE kind='generated') AS generated, count(*) FILTER (WHERE kind='fallback') AS fallback,
 count(*) FILTER (WHERE kind='real') AS real_frames, count(*) AS output_frames FROM tl GROUP BY 1""")
def fg_totals(spark, d):
    return T.fg_totals(timeline(spark, d))


@query("d18_compare_runs", with_fixtures("stage") + """,
a AS (SELECT clip_id, frame_no, decode_ms, flow_ms FROM stage WHERE frame_no % 10 <> 3),
b AS (SELECT clip_id, frame_no, decode_ms*.75e0 AS decode_ms, flow_ms+1 AS flow_ms FROM stage WHERE frame_no % 10 <> 7)
SELECT coalesce(a.clip_id,b.clip_id) AS clip_id, coalesce(a.frame_no,b.frame_no) AS frame_no,
 CASE WHEN a.clip_id IS NULL THEN 'b' WHEN b.clip_id IS NULL THEN 'a' ELSE 'both' END AS present,
 a.decode_ms AS decode_ms_a, b.decode_ms AS decode_ms_b, b.decode_ms-a.decode_ms AS decode_ms_delta,
 a.flow_ms AS flow_ms_a, b.flow_ms AS flow_ms_b, b.flow_ms-a.flow_ms AS flow_ms_delta FROM a FULL OUTER JOIN b ON a.clip_id=b.clip_id AND a.frame_no=b.frame_no""")
def compare_runs(spark, d):
    """Run A lost every frame ending in 3, run B every frame ending in 7."""
    s = fx.stage(spark, d)
    b = s.where("frame_no % 10 <> 7").withColumn("decode_ms", F.col("decode_ms") * 0.75).withColumn("flow_ms", F.col("flow_ms") + 1)
    return T.compare_runs(s.where("frame_no % 10 <> 3"), b, ["decode_ms", "flow_ms"])


_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
HALF_DAY = 43200


def _seconds(spark, d):
    return fx.track(spark, d).select("track_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"))


@query("f06_rate_limit", f"""
WITH RECURSIVE e AS (SELECT user_id AS track_id, {_SECONDS} AS t FROM events),
r AS (SELECT track_id, min(t) AS t FROM e GROUP BY track_id
 UNION ALL SELECT track_id, t FROM (SELECT r.track_id, min(e.t) AS t FROM r JOIN e ON e.track_id=r.track_id AND e.t >= r.t+{HALF_DAY} GROUP BY r.track_id, r.t))
SELECT track_id, CAST(t AS DOUBLE) AS t FROM r""")
def rate_limit(spark, d):
    return T.rate_limit(_seconds(spark, d), "track_id", "t", float(HALF_DAY))


@query("f06_rate_limit_buckets", f"""
SELECT user_id AS track_id, CAST(floor({_SECONDS}/{HALF_DAY}e0) AS BIGINT) AS bucket, CAST(min({_SECONDS}) AS DOUBLE) AS t FROM events GROUP BY 1,2""")
def rate_limit_buckets(spark, d):
    return T.rate_limit_buckets(_seconds(spark, d), "track_id", "t", float(HALF_DAY))


def _pass_sql() -> str:
    w = _EDGE_W.format(s=".0792").replace("n.l", "n.v/255e0").replace("c.l", "c.v/255e0")
    out, src = "p0 AS (SELECT clip_id, frame_no, y, x, CAST(g AS DOUBLE) AS v FROM px)", "p0"
    for i in (1, 2, 3):
        out += "," + nine_join(f"p{i}", src, f"sum(n.v*{w})/sum({w}) AS v", 8, 8)
        src = f"p{i}"
    return out


@query("f08_iterate_passes", with_fixtures("px") + "," + _pass_sql() + f" SELECT {_C}, round(v,6) AS v FROM p3")
def passes(spark, d):
    """Three passes of the edge-aware mean over the green channel."""
    p = fx.px(spark, d).select(*CELL, F.col("g").cast("double").alias("v"))

    def step(df):
        e = L.edge_aware_mean(df.withColumn("l", F.col("v") / 255.0), "l", ["v"], 0.72)
        return e.select(*CELL, F.col("v_mean").alias("v"))

    return iterate_passes(p, step, 3).withColumn("v", r6(F.col("v")))
