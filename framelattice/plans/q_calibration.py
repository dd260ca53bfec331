"""Queries over depth and motion calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import big, r6
from ..operators import calibration as K
from ..operators.pairs import informative_pairs, pair_mad
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .q_pairs import MAD_SQL
from .registry import query
from .sqltext import LUMA, bilinear, on

_C = "clip_id, frame_no, y, x"

_STATS = f"""pick AS (SELECT DISTINCT seq_id, frame_no FROM chan),
nf AS (SELECT seq_id, count(*) AS frames FROM pick GROUP BY 1),
v AS (SELECT c.seq_id, c.channel, c.value AS v FROM chan c JOIN pick p ON p.seq_id=c.seq_id AND p.frame_no=c.frame_no WHERE isfinite(c.value)),
q AS (SELECT seq_id, channel, count(*) AS fc, quantile_cont(v,.001) AS p001, quantile_cont(v,.01) AS p01, quantile_cont(v,.1) AS p10,
  quantile_cont(v,.5) AS p50, quantile_cont(v,.9) AS p90, quantile_cont(v,.99) AS p99, quantile_cont(v,.999) AS p999,
  avg(CASE WHEN v>=0 THEN 1e0 ELSE 0e0 END) AS positive_ratio, avg(CASE WHEN v>=-1e-5 AND v<=1.00001e0 THEN 1e0 ELSE 0e0 END) AS in01_ratio FROM v GROUP BY 1,2),
z AS (SELECT q.*, nf.frames, p99-p01 AS robust_span, fc/greatest(1e0, greatest(nf.frames*64, fc)) AS finite_ratio, greatest(1e0,abs(p01),abs(p99)) AS mag FROM q JOIN nf ON nf.seq_id=q.seq_id),
st AS (SELECT *, CASE channel WHEN 'R' THEN 1.8e0 WHEN 'G' THEN 1.4e0 WHEN 'B' THEN 1e0 ELSE -8e0 END AS pri,
  CASE channel WHEN 'R' THEN 1.8e0 WHEN 'G' THEN 1.4e0 WHEN 'B' THEN 1e0 ELSE -8e0 END + finite_ratio*2 + positive_ratio*1.5e0
  + least(greatest(robust_span/mag*5,0e0),3e0) - CASE WHEN robust_span<=greatest(1e-7,mag*1e-6) THEN 12e0 ELSE 0e0 END
  - CASE WHEN channel='A' AND in01_ratio>.99e0 THEN 6e0 ELSE 0e0 END AS score FROM z)"""
_QN = ["p001", "p01", "p10", "p50", "p90", "p99", "p999", "robust_span", "finite_ratio", "positive_ratio", "in01_ratio", "score"]


@query("d09_channel_stats", with_fixtures("chan") + "," + _STATS + " SELECT seq_id, channel, fc AS finite_count, frames, "
       + ", ".join(f"round({c},6)+0e0 AS {c}" for c in _QN) + " FROM st")
def channel_stats(spark, d):
    s = K.channel_stats(fx.chan(spark, d), 8, 8)
    return s.select("seq_id", "channel", "finite_count", "frames", *[r6(F.col(c)).alias(c) for c in _QN])


@query("d10_calibrate_depth", with_fixtures("chan") + "," + _STATS + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, channel) AS rank FROM st),
b AS (SELECT a.*, c.score AS second FROM rk a LEFT JOIN rk c ON c.seq_id=a.seq_id AND c.rank=2 WHERE a.rank=1),
m AS (SELECT *, in01_ratio>=.995e0 AND p001>=-1e-4 AND p999<=1.0001e0 AS raw FROM b)
SELECT seq_id, robust_span>1e-12 AS success, channel, CASE WHEN raw THEN 'raw01' ELSE 'fixed_range' END AS mapping,
 round(CASE WHEN raw THEN 0e0 WHEN p99>p01 THEN p01 ELSE p001 END,6) AS near, round(CASE WHEN raw THEN 1e0 WHEN p99>p01 THEN p99 ELSE p999 END,6) AS far,
 round(least(greatest(.35e0*finite_ratio+.25e0*least(greatest(robust_span/greatest(1e-6,abs(p99))*3,0e0),1e0)
  +.2e0*least(greatest((pri+2)/10e0,0e0),1e0)+.2e0*CASE WHEN second IS NULL THEN 1e0 ELSE least(greatest((score-second+1)/6e0,0e0),1e0) END,0e0),1e0),6) AS confidence,
 frames AS sampled_frames FROM m""")
def calibrate_depth(spark, d):
    out = K.calibrate_depth(K.channel_stats(fx.chan(spark, d), 8, 8))
    return out.select("seq_id", "success", "channel", "mapping", r6(F.col("near")).alias("near"), r6(F.col("far")).alias("far"),
                      r6(F.col("confidence")).alias("confidence"), "sampled_frames")


_PAIRS = MAD_SQL.replace("lum AS", "mlum AS").replace("FROM lum a JOIN lum b", "FROM mlum a JOIN mlum b") + """,
pairs AS (SELECT clip_id, frame_no FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(mad,9) DESC, frame_no) AS rank FROM mads
  WHERE mad>=.003e0 AND mad<=.55e0) WHERE rank<=6)"""
_ZERO = f"""lum AS (SELECT {_C}, {LUMA} AS l FROM wpx),
zp AS (SELECT a.clip_id, a.frame_no, avg(least(abs(b.l-a.l)/255e0,.35e0)/.35e0) AS e FROM lum a JOIN lum b ON b.clip_id=a.clip_id AND b.frame_no=a.frame_no-1 AND b.y=a.y AND b.x=a.x
  JOIN pairs p ON {on('p', 'a')} GROUP BY 1,2),
zero AS (SELECT clip_id, avg(e) AS zero_error, count(*) AS sampled_pairs FROM zp GROUP BY 1)"""


@query("d11_zero_motion_error", with_fixtures("wpx") + "," + _PAIRS + "," + _ZERO
       + " SELECT clip_id, round(zero_error,6) AS zero_error, sampled_pairs FROM zero")
def zero_motion_error(spark, d):
    p = fx.wide_px(spark, d)
    return K.zero_motion_error(p, informative_pairs(pair_mad(p))).withColumn("zero_error", r6(F.col("zero_error")))


def motion_channels(spark, d):
    """Channel listing of the motion guidance, alphabetical as a file header lists it."""
    ordinal = F.when(F.col("channel") == "A", 0).when(F.col("channel") == "B", 1).when(F.col("channel") == "G", 2).otherwise(3)
    return fx.motion_chan(spark, d).select("seq_id", "channel").distinct().withColumn("ordinal", ordinal)


_CONV = """conv AS (SELECT ((u*5+f)*4+s)*2+dr AS ordinal, [1e0,48e0,24e0][u+1]*[.25e0,.5e0,1e0,2e0,4e0][f+1] AS sx, [1e0,32e0,16e0][u+1]*[.25e0,.5e0,1e0,2e0,4e0][f+1] AS sy,
  (s&1)=1 AS flip_x, (s&2)=2 AS flip_y, dr=1 AS forward, ['pixels','UV','NDC'][u+1] || ['x0.25','x0.5','','x2','x4'][f+1] AS unit0,
  ['pixels','UV','NDC'][u+1] || [' x0.25',' x0.5','',' x2',' x4'][f+1] AS unit
  FROM range(3) a(u), range(5) b(f), range(4) c(s), range(2) e(dr)),
slots AS (SELECT * FROM (VALUES ('R',1,10),('G',2,10),('B',3,0),('A',4,-8)) t(channel, slot, pr)),
cand AS (SELECT x.channel AS xc, y.channel AS yc, x.slot AS xs, y.slot AS ys, conv.* FROM slots x JOIN slots y ON x.slot<>y.slot CROSS JOIN conv)"""
# Listing order A, B, G, R with priors -8, 0, 10, 10 gives the slots G, R, B, A.
_CONV = _CONV.replace("('R',1,10),('G',2,10)", "('G',1,10),('R',2,10)")


@query("c12_candidate_grid", with_fixtures("wpx") + "," + _CONV
       + " SELECT s.clip_id AS seq_id, xc AS x_channel, yc AS y_channel, ordinal, sx, sy, flip_x, flip_y, forward, unit "
         "FROM cand CROSS JOIN (SELECT DISTINCT clip_id FROM wpx) s")
def candidate_grid(spark, d):
    kept = K.limit_motion_channels(motion_channels(spark, d))
    return K.candidate_grid(kept, 48, 32).select("seq_id", "x_channel", "y_channel", big("ordinal").alias("ordinal"), "sx", "sy",
                                                 "flip_x", "flip_y", "forward", "unit")


_ERR = _CONV + f""",
smp AS (SELECT l.clip_id, l.frame_no+dr AS pair, dr=1 AS fwd, l.frame_no + (CASE dr WHEN 1 THEN 1 ELSE -1 END) AS pf, l.frame_no AS ff, l.y, l.x, l.l
  FROM lum l CROSS JOIN range(2) e(dr) JOIN pairs p ON p.clip_id=l.clip_id AND p.frame_no=l.frame_no+dr),
ch AS (SELECT * FROM mchan),
ev AS (SELECT s.clip_id, s.pf AS frame_no, s.y, s.x, s.l, c.xs, c.ys, c.ordinal, a.value*c.sx*CASE WHEN c.flip_x THEN -1 ELSE 1 END AS dx,
  b.value*c.sy*CASE WHEN c.flip_y THEN -1 ELSE 1 END AS dy FROM smp s JOIN cand c ON c.forward=s.fwd
  JOIN ch a ON a.seq_id=s.clip_id AND a.frame_no=s.ff AND a.y=s.y AND a.x=s.x AND a.channel=c.xc
  JOIN ch b ON b.seq_id=s.clip_id AND b.frame_no=s.ff AND b.y=s.y AND b.x=s.x AND b.channel=c.yc),
""" + bilinear("w", "ev", "(SELECT clip_id, frame_no, y, x, l AS pl FROM lum)", {"pl": "pl"}, "x+dx", "y+dy", 48, 32, flag="ins", how="JOIN") + """,
er AS (SELECT clip_id, xs, ys, ordinal, avg(CASE WHEN abs(dx)<=96 AND abs(dy)<=64 AND ins THEN least(abs(l-pl)/255e0,.35e0)/.35e0 ELSE 1e0 END) AS e0,
  sum(CASE WHEN abs(dx)<=96 AND abs(dy)<=64 THEN sqrt(dx*dx+dy*dy) ELSE 0e0 END)/count(*) AS mm, count(*) AS samples FROM w GROUP BY 1,2,3,4),
err AS (SELECT er.clip_id, c.*, e0 + CASE WHEN mm<.025e0 THEN .025e0 ELSE 0e0 END AS error, mm, samples FROM er JOIN cand c ON c.xs=er.xs AND c.ys=er.ys AND c.ordinal=er.ordinal)"""


def _errors(spark, d):
    p = fx.wide_px(spark, d)
    pairs = informative_pairs(pair_mad(p))
    kept = K.limit_motion_channels(motion_channels(spark, d))
    return p, pairs, K.motion_candidate_error(p, fx.motion_chan(spark, d), kept, pairs, 48, 32)


@query("d12_motion_candidate_error", with_fixtures("wpx", "mchan") + "," + _PAIRS + f", lum AS (SELECT {_C}, {LUMA} AS l FROM wpx)," + _ERR
       + " SELECT clip_id, xc AS x_channel, yc AS y_channel, ordinal, unit, round(error,6) AS error, round(mm,6) AS mean_motion, samples FROM err")
def motion_candidate_error(spark, d):
    e = _errors(spark, d)[2]
    return e.select("clip_id", "x_channel", "y_channel", big("ordinal").alias("ordinal"), "unit", r6(F.col("error")).alias("error"),
                    r6(F.col("mean_motion")).alias("mean_motion"), "samples")


_AX = "CASE {c} WHEN '{a}' THEN 0e0 WHEN '{b}' THEN .02e0 WHEN 'B' THEN .035e0 ELSE .07e0 END"


@query("d13_calibrate_motion", with_fixtures("wpx", "mchan") + "," + _PAIRS + "," + _ZERO + "," + _ERR + f""",
co AS (SELECT *, error + {_AX.format(c='xc', a='R', b='G')} + {_AX.format(c='yc', a='G', b='R')} + CASE WHEN unit<>'pixels' THEN .002e0 ELSE 0e0 END
  + CASE WHEN forward THEN .006e0 ELSE 0e0 END + CASE WHEN flip_x THEN .0002e0 ELSE 0e0 END + CASE WHEN flip_y THEN .0002e0 ELSE 0e0 END AS cost,
  CASE xc WHEN 'R' THEN 10 WHEN 'A' THEN -8 ELSE 0 END + CASE yc WHEN 'G' THEN 10 WHEN 'A' THEN -8 ELSE 0 END + CASE WHEN unit='pixels' THEN 5 ELSE 0 END AS prior FROM err),
rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(cost,7), prior DESC, xs, ys, ordinal) AS rank FROM co),
b AS (SELECT a.*, c.cost AS second, z.zero_error, z.sampled_pairs FROM rk a JOIN rk c ON c.clip_id=a.clip_id AND c.rank=2 JOIN zero z ON z.clip_id=a.clip_id WHERE a.rank=1),
k AS (SELECT *, error < zero_error*.999e0 AS ok FROM b)
SELECT clip_id, ok AS success, CASE WHEN ok THEN xc END AS x_channel, CASE WHEN ok THEN yc END AS y_channel, CASE WHEN ok THEN sx END AS sx, CASE WHEN ok THEN sy END AS sy,
 CASE WHEN ok THEN flip_x END AS flip_x, CASE WHEN ok THEN flip_y END AS flip_y, CASE WHEN ok THEN CASE WHEN forward THEN 'previous_to_current' ELSE 'current_to_previous' END END AS direction,
 CASE WHEN ok THEN unit END AS unit, round(error,6) AS best_error, round(zero_error,6) AS zero_error,
 CASE WHEN ok THEN round(least(greatest(.65e0*least(greatest((zero_error-error)/greatest(1e-5,zero_error),0e0),1e0)+.25e0*least(greatest((second-cost)/greatest(1e-5,second),0e0),1e0)
  +.1e0*least(greatest(mm/2e0,0e0),1e0),0e0),1e0),6) END AS confidence, sampled_pairs FROM k""")
def calibrate_motion(spark, d):
    p, pairs, errors = _errors(spark, d)
    out = K.calibrate_motion(errors, K.zero_motion_error(p, pairs))
    return out.select(*[r6(F.col(c)).alias(c) if c in ("best_error", "zero_error", "confidence") else F.col(c) for c in out.columns])
