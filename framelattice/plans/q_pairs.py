"""Queries over frame-pair statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..functions.colour import luma8
from ..operators import pairs as P
from ..operators.preview import robust_magnitude
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .registry import query
from .sqltext import LUMA, on

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"
# The cut threshold that separates the planted cuts of the rasters from their noise.
CUT = 0.40
G8 = f"CAST(least(round({LUMA}),255) AS INT)"


def cut_sql(gray: str, first: str = "1e0") -> str:
    """CTE ``scores`` over ``gray`` (clip_id, frame_no, y, x, v)."""
    return f"""bins AS (SELECT clip_id, frame_no, least(31, CAST(floor(v*32/256e0) AS INT)) AS bin, count(*) AS c FROM {gray} GROUP BY 1,2,3),
fr AS (SELECT clip_id, frame_no, count(*) AS n FROM {gray} GROUP BY 1,2),
hl AS (SELECT clip_id, frame_no, sum(abs(d)) AS l1 FROM (SELECT clip_id, frame_no, bin, sum(c) AS d FROM
  (SELECT clip_id, frame_no, bin, c FROM bins UNION ALL SELECT clip_id, frame_no+1, bin, -c FROM bins) GROUP BY 1,2,3) GROUP BY 1,2),
pm AS (SELECT a.clip_id, a.frame_no, avg(abs(a.v-b.v)) AS m FROM {gray} a JOIN {gray} b ON b.clip_id=a.clip_id AND b.frame_no=a.frame_no-1 AND b.y=a.y AND b.x=a.x GROUP BY 1,2),
scores AS (SELECT fr.clip_id, fr.frame_no, pm.m IS NULL AS is_first, CASE WHEN pm.m IS NULL THEN {first}
  ELSE least(greatest((hl.l1/fr.n)*.5e0*.65e0 + pm.m/255e0*.35e0,0e0),1e0) END AS score
  FROM fr JOIN hl ON {on('hl', 'fr')} LEFT JOIN pm ON {on('pm', 'fr')}),
segments AS (SELECT *, is_first OR score >= {CUT}e0 AS cut,
  CAST(sum(CASE WHEN is_first OR score >= {CUT}e0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_no) AS BIGINT) AS scene_id FROM scores)"""


def scores(spark, d, variant="resampled", wide=False):
    p = fx.wide_px(spark, d) if wide else fx.px(spark, d)
    w, h = (48, 32) if wide else (8, 8)
    return P.scene_cut_score(P.gray_cells(p, variant, w, h))


def gray8(spark, d, wide=False):
    p = fx.wide_px(spark, d) if wide else fx.px(spark, d)
    return p.select(*CELL, luma8(F.col("r"), F.col("g"), F.col("b")).alias("v"))


GRAY_CTE = f"gray AS (SELECT {_C}, {G8} AS v FROM px)"
WGRAY_CTE = f"gray AS (SELECT {_C}, {G8} AS v FROM wpx)"
_OUT = " SELECT clip_id, frame_no, is_first, round(score,6) AS score FROM scores"


def _out(s):
    return s.select("clip_id", "frame_no", "is_first", r6(F.col("score")).alias("score"))


@query("d01_scene_cut_score", with_fixtures("px") + "," + GRAY_CTE + "," + cut_sql("gray") + _OUT)
def scene_cut_score(spark, d):
    return _out(scores(spark, d))


@query("d01_scene_cut_every4", with_fixtures("wpx") + f", gray AS (SELECT {_C}, {LUMA} AS v FROM wpx WHERE y%4=0 AND x%4=0)," + cut_sql("gray") + _OUT)
def scene_cut_every4(spark, d):
    """The sparse variant looks at every fourth pixel in both directions."""
    return _out(scores(spark, d, "every4", wide=True))


@query("d01_scene_cut_gray", with_fixtures("wpx") + "," + WGRAY_CTE + "," + cut_sql("gray", "0e0") + _OUT)
def scene_cut_gray(spark, d):
    return _out(P.scene_cut_score(P.gray_cells(gray8(spark, d, True), "gray", 48, 32), first_score=0.0))


@query("d02_rgb_l1_score", with_fixtures("px") + """
SELECT p.clip_id, p.frame_no, round(coalesce(avg((abs(p.r-q.r)+abs(p.g-q.g)+abs(p.b-q.b))/3e0)/255e0,1e0),6) AS score, count(q.r)=0 AS is_first
FROM px p LEFT JOIN px q ON q.clip_id=p.clip_id AND q.frame_no=p.frame_no-1 AND q.y=p.y AND q.x=p.x GROUP BY 1,2""")
def rgb_l1_score(spark, d):
    return P.rgb_l1_score(fx.px(spark, d)).withColumn("score", r6(F.col("score")))


@query("d03_scene_segments", with_fixtures("px") + "," + GRAY_CTE + "," + cut_sql("gray")
       + " SELECT clip_id, frame_no, round(score,6) AS score, cut, scene_id FROM segments")
def scene_segments(spark, d):
    return P.scene_segments(scores(spark, d), CUT).select("clip_id", "frame_no", r6(F.col("score")).alias("score"), "cut", "scene_id")


MAD_SQL = f"""lum AS (SELECT {_C}, {LUMA} AS l FROM wpx),
mads AS (SELECT a.clip_id, a.frame_no, sum(abs(a.l-b.l))/255e0/count(*) AS mad FROM lum a JOIN lum b
  ON b.clip_id=a.clip_id AND b.frame_no=a.frame_no-1 AND b.y=a.y AND b.x=a.x GROUP BY 1,2)"""


@query("d04_pair_mad", with_fixtures("wpx") + "," + MAD_SQL + " SELECT clip_id, frame_no, round(mad,6) AS mad FROM mads")
def pair_mad(spark, d):
    return P.pair_mad(fx.wide_px(spark, d)).withColumn("mad", r6(F.col("mad")))


@query("d04_informative_pairs", with_fixtures("px") + "," + MAD_SQL.replace("wpx", "px") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(mad,9) DESC, frame_no) AS rank FROM mads WHERE mad>=.003e0 AND mad<=.55e0)
SELECT clip_id, frame_no, round(mad,6) AS mad, rank FROM r WHERE rank<=3""")
def informative_pairs(spark, d):
    m = P.pair_mad(fx.px(spark, d))
    return P.informative_pairs(m, 3).select("clip_id", "frame_no", r6(F.col("mad")).alias("mad"), "rank")


@query("d05_minmax_normalize", with_fixtures("chan") + """,
c AS (SELECT seq_id, frame_no, channel, y, x, CASE WHEN channel<>'A' AND y=x AND y<2 THEN 'nan'::DOUBLE ELSE value END AS v FROM chan),
b AS (SELECT seq_id, frame_no, channel, min(v) FILTER (WHERE isfinite(v)) AS lo, max(v) FILTER (WHERE isfinite(v)) AS hi FROM c GROUP BY 1,2,3)
SELECT c.seq_id, c.frame_no, c.channel, y, x, CASE WHEN hi-lo<1e-12 THEN 0e0
  ELSE round(least(greatest((CASE WHEN isfinite(v) THEN v ELSE lo END-lo)/(hi-lo),0e0),1e0),6) END AS v
FROM c JOIN b ON b.seq_id=c.seq_id AND b.frame_no=c.frame_no AND b.channel=c.channel""")
def minmax_normalize(spark, d):
    hole = (F.col("channel") != "A") & (F.col("y") == F.col("x")) & (F.col("y") < 2)
    c = fx.chan(spark, d).withColumn("v", F.when(hole, float("nan")).otherwise(F.col("value"))).drop("value")
    out = P.minmax_normalize(c, "v", ("seq_id", "frame_no", "channel"))
    return out.withColumn("v", r6(F.col("v")))


STATS_SQL = f"""dif AS (SELECT a.clip_id, a.frame_no, a.y, a.x, abs(a.v-b.v) AS ad FROM gray a JOIN gray b ON b.clip_id=a.clip_id AND b.frame_no=a.frame_no-1 AND b.y=a.y AND b.x=a.x),
stats AS (SELECT f.clip_id, f.frame_no, quantile_cont(sqrt(vx*vx+vy*vy),.5) AS p50, quantile_cont(sqrt(vx*vx+vy*vy),.9) AS p90,
  quantile_cont(sqrt(vx*vx+vy*vy),.95) AS p95, avg(confidence) AS mean_conf, avg(CASE WHEN confidence<.25e0 THEN 1e0 ELSE 0e0 END) AS bad_ratio,
  avg(ad)/255e0 AS mad, avg(CASE WHEN ad>8 THEN 1e0 ELSE 0e0 END) AS changed_ratio
  FROM flow f JOIN dif ON {on('dif', 'f', ('clip_id', 'frame_no', 'y', 'x'))} GROUP BY 1,2)"""
_STATS = ["p50", "p90", "p95", "mean_conf", "bad_ratio", "mad", "changed_ratio"]


@query("d06_flow_stats", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + STATS_SQL
       + " SELECT clip_id, frame_no, " + ", ".join(f"round({c},8) AS {c}" for c in _STATS) + " FROM stats")
def flow_stats(spark, d):
    s = P.flow_stats(fx.flow(spark, d), gray8(spark, d))
    return s.select("clip_id", "frame_no", *[r6(F.col(c), 8).alias(c) for c in _STATS])


@query("d07_stability_gates", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + STATS_SQL + """
SELECT clip_id, frame_no, round(mean_conf-.12e0*bad_ratio,12) AS candidate_score,
 mean_conf<.78e0 OR bad_ratio>.18e0 OR (p95>24 AND mean_conf<.9e0) AS needs_rescue,
 mad<.01e0 AND changed_ratio<.02e0 AND p50<.12e0 AND p95<1.5e0 AS near_duplicate FROM stats""")
def stability_gates(spark, d):
    g = P.stability_gates(P.flow_stats(fx.flow(spark, d), gray8(spark, d)))
    return g.withColumn("candidate_score", r6(F.col("candidate_score"), 12))


@query("d08_robust_magnitude", with_fixtures("wflow") + """,
m AS (SELECT clip_id, frame_no, sqrt((vx*2)*(vx*2)+(vy*.5e0)*(vy*.5e0)) AS m FROM wflow),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_no ORDER BY m) AS rn, count(*) OVER (PARTITION BY clip_id, frame_no) AS n FROM m)
SELECT clip_id, frame_no, round(m,6) AS robust_magnitude, n AS samples FROM r WHERE rn=CAST(floor((n-1)*.95e0) AS BIGINT)+1""")
def robust_magnitude_q(spark, d):
    return robust_magnitude(fx.wide_flow(spark, d), 2.0, 0.5).withColumn("robust_magnitude", r6(F.col("robust_magnitude")))


def _alternate(spark, d):
    # The alternate field halves the vectors and trusts odd frames more.
    f = fx.flow(spark, d)
    up = F.least(F.lit(1.0), F.col("confidence") + F.when(F.col("frame_no") % 2 == 1, 0.0625).otherwise(-0.0625))
    return f.withColumn("vx", F.col("vx") * 0.5).withColumn("confidence", up)


_ALT = f"""alt AS (SELECT {_C}, vx*.5e0 AS vx, vy, least(1e0, confidence + CASE WHEN frame_no%2=1 THEN .0625e0 ELSE -.0625e0 END) AS confidence FROM flow),
a AS (SELECT clip_id, frame_no, mean_conf-.12e0*bad_ratio AS s, mean_conf<.78e0 OR bad_ratio>.18e0 OR (p95>24 AND mean_conf<.9e0) AS tried FROM stats),
b AS (SELECT clip_id, frame_no, avg(confidence)-.12e0*avg(CASE WHEN confidence<.25e0 THEN 1e0 ELSE 0e0 END) AS s FROM alt GROUP BY 1,2),
ch AS (SELECT a.clip_id, a.frame_no, a.s AS sa, b.s AS sb, a.tried, a.tried AND b.s > a.s+.005e0 AS alt FROM a JOIN b ON {on('a', 'b')})"""


@query("c13_choose_candidate", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + STATS_SQL + "," + _ALT + """
SELECT clip_id, frame_no, round(sa,12) AS primary_score, tried, round(sb,12) AS alternate_score, alt AS use_alternate FROM ch""")
def choose_candidate(spark, d):
    g = gray8(spark, d)
    c = P.choose_candidate(P.flow_stats(fx.flow(spark, d), g), P.flow_stats(_alternate(spark, d), g))
    return c.withColumn("primary_score", r6(F.col("primary_score"), 12)).withColumn("alternate_score", r6(F.col("alternate_score"), 12))


@query("c13_select_field", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + STATS_SQL + "," + _ALT + f"""
SELECT f.clip_id, f.frame_no, f.y, f.x, CASE WHEN ch.alt THEN alt.vx ELSE f.vx END AS vx, CASE WHEN ch.alt THEN alt.confidence ELSE f.confidence END AS confidence
FROM flow f JOIN alt ON {on('alt', 'f', ('clip_id', 'frame_no', 'y', 'x'))} JOIN ch ON {on('ch', 'f')}""")
def select_field(spark, d):
    g = gray8(spark, d)
    f, alt = fx.flow(spark, d), _alternate(spark, d)
    c = P.choose_candidate(P.flow_stats(f, g), P.flow_stats(alt, g))
    cols = [*CELL, "vx", "confidence"]
    return P.select_field(c, f.select(*cols), alt.select(*cols))
