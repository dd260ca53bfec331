"""Queries over streams: each runs its stream to the end of the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..common import KEYS, big, r6
from ..sources import fixtures as fx
from ..sources.fields import long_to_planes
from ..sources.fixtures import with_fixtures
from ..streaming import stateful as S
from ..streaming import telemetry as T
from .q_ordered import tracks_sql
from .q_pairs import CUT, GRAY_CTE, cut_sql, gray8
from .q_telemetry import PROGRESS_SQL, stage_log
from .registry import query


END = datetime(2200, 1, 1)


def at_rate(df, fps: float = 25.0):
    """Frames with the event time of a run that starts at the epoch."""
    return df.withColumn("ts", F.timestamp_millis((F.col("frame_no") * 1000 / fps).cast("long")))


@query("g01_stream_scene_state", with_fixtures("px") + "," + GRAY_CTE + "," + cut_sql("gray")
       + " SELECT clip_id, frame_no, round(score,6) AS score, cut, scene_id FROM segments")
def stream_scene_state(spark, d):
    frames = S.pack_gray(long_to_planes(gray8(spark, d), ["v"]))
    out = T.drain(S.stream_scene_state(T.as_stream(at_rate(frames), 8, end={"ts": END}), CUT))
    return out.drop("late").withColumn("score", r6(F.col("score")))


@query("g01_stream_lost_frames", with_fixtures("px") + "," + GRAY_CTE + " , kept AS (SELECT * FROM gray WHERE frame_no%5<>3)," + cut_sql("kept")
       + " SELECT clip_id, frame_no, round(score,6) AS score, cut, scene_id FROM segments")
def stream_lost_frames(spark, d):
    """Every fifth frame never comes: the stream starts a scene after each gap, as the batch does."""
    frames = S.pack_gray(long_to_planes(gray8(spark, d).where("frame_no % 5 <> 3"), ["v"]))
    out = T.drain(S.stream_scene_state(T.as_stream(at_rate(frames), 8, end={"ts": END}), CUT))
    return out.drop("late").withColumn("score", r6(F.col("score")))


@query("g02_stream_consensus", tracks_sql("strong"))
def stream_consensus(spark, d):
    t = fx.track(spark, d).select("track_id", "frame_no", "vx", "vy", "confidence")
    out = T.drain(S.stream_consensus(T.as_stream(at_rate(t), 8, end={"ts": END}, late="1 minute"), "strong", "1 minute"))
    return out.select("track_id", "frame_no", "history", *[r6(F.col(c)).alias(c) for c in ("blend", "out_vx", "out_vy")])


@query("g03_stream_telemetry", with_fixtures("stage") + """
SELECT CAST(floor(epoch(ts)/86400) AS BIGINT) AS day, clip_id, count(*) AS frames, round(avg(decode_ms),6) AS avg_decode_ms, round(avg(flow_ms),6) AS avg_flow_ms,
 round(avg(denoise_ms),6) AS avg_denoise_ms, round(1000e0*count(*)/sum(decode_ms+flow_ms+denoise_ms),6) AS fps FROM stage GROUP BY 1,2""")
def stream_telemetry(spark, d):
    s = stage_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.drain(T.stream_stage_means(T.as_stream(s, 8, end={"ts": END}), "1 day", "3650 days"))
    return out.select(big(F.floor(F.unix_timestamp("window_start") / 86400)).alias("day"), "clip_id", "frames",
                      *[r6(F.col(c)).alias(c) for c in ("avg_decode_ms", "avg_flow_ms", "avg_denoise_ms", "fps")])


@query("g03_stream_progress", PROGRESS_SQL)
def stream_progress(spark, d):
    s = stage_log(spark, d)
    s = s.join(s.groupBy("clip_id").agg((F.count(F.lit(1)) + 5).alias("total_frames")), "clip_id").select("clip_id", "frame_no", "total_ms", "total_frames")
    p = T.drain(S.stream_progress(T.as_stream(at_rate(s), 8, end={"ts": END}, late="1 day"), "1 day"))
    return p.select("clip_id", "frame_no", "done", *[r6(F.col(c)).alias(c) for c in ("elapsed_s", "fps", "fraction")],
                    (F.floor(F.col("eta_s") * 1e6 + 0.5) / 1e6).alias("eta_s"))


_PAUSE = 4 * 3600


def _times(spark, d):
    return fx.stage(spark, d).select("clip_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"))


_STALL_SQL = with_fixtures("stage") + f""",
l AS (SELECT clip_id, CAST(floor(epoch(ts)) AS DOUBLE) AS last_t, lead(CAST(floor(epoch(ts)) AS DOUBLE)) OVER (PARTITION BY clip_id ORDER BY floor(epoch(ts))) AS next_t FROM stage)
SELECT clip_id, last_t, next_t FROM l WHERE next_t - last_t > {_PAUSE}"""


@query("g04_stall_audit", _STALL_SQL)
def stall_audit(spark, d):
    return T.stall_audit(_times(spark, d), _PAUSE)


@query("g04_stall_watch", _STALL_SQL)
def stall_watch(spark, d):
    """The stream form: rows in any order over many files, as late as the table is long."""
    out = T.drain(S.stream_stall_watch(T.as_stream(_times(spark, d), 8, end={"t": END.timestamp()}), _PAUSE, "3650 days"))
    return out.where("state = 'resumed'").select("clip_id", "last_t", "next_t")


@query("g04_partial_frames", with_fixtures("stage") + """
SELECT clip_id, frame_no, CAST(sum(b) AS BIGINT) AS got, CAST(1000 AS BIGINT) AS want, CASE WHEN sum(b) >= 1000 THEN 'complete' ELSE 'partial' END AS state
FROM (SELECT clip_id, frame_no, unnest(CASE WHEN (clip_id+frame_no)%7=3 THEN [400,400] ELSE [400,400,200] END) AS b FROM stage) GROUP BY 1,2""")
def partial_frames(spark, d):
    """Every frame of the log comes in parts of its thousand bytes; of every seventh the last never comes."""
    log = fx.stage(spark, d).select("clip_id", "frame_no", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    lost = F.pmod(F.col("clip_id") + F.col("frame_no"), F.lit(7)) == 3
    parts = log.select("*", F.explode(F.when(lost, F.array(*[F.lit(b) for b in (400, 400)])).otherwise(F.array(*[F.lit(b) for b in (400, 400, 200)])).cast("array<bigint>")).alias("bytes"),
                       F.lit(1000).cast("long").alias("frame_bytes"))
    return T.drain(S.stream_whole_frames(T.as_stream(parts, 8, end={"t": END.timestamp()}), 30.0, "3650 days"))
