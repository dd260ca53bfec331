"""Queries over grid reliability, camera motion, repair and the guidance policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..operators import reliability as R
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .q_lattice import LUMA_CTE, landing_sql
from .registry import query
from .sqltext import bilinear, cl, on, previous

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"
_K4 = ("clip_id", "frame_no", "y", "x")
_FIELDS = ["vx", "vy", "confidence", "visibility", "disocclusion", "occlusion", "uncertainty"]

RELIABILITY_SQL = (
    "gd AS (SELECT clip_id, frame_no, gy, gx, fx/32e0 AS fx, fy/32e0 AS fy, bx/32e0 AS bx, by_/32e0 AS by_, cost_f/255e0 AS cf, cost_b/255e0 AS cb FROM grid),"
    + landing_sql("fl", "fx", "fy", 4, 4, 8, 8, "gd") + "," + landing_sql("bl", "bx", "by_", 4, 4, 8, 8, "gd") + f""",
ga AS (SELECT g.clip_id, g.frame_no, g.gy AS y, g.gx AS x, g.fx, g.fy, g.bx, g.by_, g.cf, g.cb, fl.coverage AS fl, bl.coverage AS bl FROM gd g
  JOIN fl ON {on('fl', 'g', ('clip_id', 'frame_no', 'gy', 'gx'))} JOIN bl ON {on('bl', 'g', ('clip_id', 'frame_no', 'gy', 'gx'))}),
lum1 AS (SELECT {_C}, l/255e0 AS l FROM lum),""" + previous("lumprev", "lum1") + ","
    + bilinear("q1", "lum1", "ga", {"fx": "vx", "fy": "vy", "cf": "c0", "bl": "rev"}, "(x+.5e0)*.5e0-.5e0", "(y+.5e0)*.5e0-.5e0", 4, 4) + ","
    + bilinear("q2", "q1", "ga", {"bx": "bvx", "by_": "bvy", "cb": "c1", "fl": "fd"}, "((x+vx)+.5e0)*.5e0-.5e0", "((y+vy)+.5e0)*.5e0-.5e0", 4, 4) + ","
    + bilinear("q3", "q2", "lumprev", {"l": "pl"}, "x+vx", "y+vy", 8, 8, flag="ins") + f""",
r1 AS (SELECT *, ins AND pl IS NOT NULL AS hist, {cl('1-c0')} AS ccf, CASE WHEN ins THEN {cl('1-c1')} ELSE 0e0 END AS ccb,
  CASE WHEN ins THEN sqrt((vx+bvx)*(vx+bvx)+(vy+bvy)*(vy+bvy)) ELSE 1000e0 END AS fb FROM q3),
r2 AS (SELECT *, CASE WHEN ins THEN exp(-fb/1.35e0) ELSE 0e0 END AS cfb, CASE WHEN hist THEN exp(-abs(l-pl)/.075e0) ELSE 0e0 END AS cp,
  greatest(CASE WHEN hist THEN 0e0 ELSE 1e0 END, {cl('(.8e0-greatest(rev,0e0))/.8e0')}) AS disocclusion,
  CASE WHEN hist THEN {cl('(greatest(fd,0e0)-1.2e0)/1.4e0')} ELSE 0e0 END AS occlusion, sqrt(greatest(0e0,ccf*ccb)) AS pair FROM r1),
r3 AS (SELECT *, {cl('exp(-fb/2.25e0)*(1-disocclusion)*(1-.55e0*occlusion)')} AS visibility, {cl('.25e0*pair+.5e0*cfb+.25e0*cp')} AS confidence FROM r2),
rel AS (SELECT {_C}, vx, vy, confidence, visibility, disocclusion, occlusion,
  {cl(f"greatest(1-{cl('.3e0*pair+.3e0*cfb+.15e0*cp+.25e0*visibility')}, .78e0*disocclusion, .48e0*occlusion)")} AS uncertainty FROM r3)""")


def reliable(spark, d, **kw):
    return R.grid_reliability(fx.grid(spark, d), fx.px(spark, d), 8, 8, 4, 4, **kw)


@query("e07_grid_reliability", with_fixtures("grid", "px") + "," + LUMA_CTE + "," + RELIABILITY_SQL
       + f" SELECT {_C}, " + ", ".join(f"round({c},6)+0e0 AS {c}" for c in _FIELDS) + " FROM rel")
def grid_reliability(spark, d):
    return reliable(spark, d).select(*CELL, *[r6(F.col(c)).alias(c) for c in _FIELDS])


@query("e07_reliability_rollup", with_fixtures("grid", "px") + "," + LUMA_CTE + "," + RELIABILITY_SQL + """
SELECT clip_id, frame_no, round(avg(visibility),6) AS mean_history_visibility, avg(CASE WHEN disocclusion>=.5e0 THEN 1e0 ELSE 0e0 END) AS disoccluded_fraction,
 avg(CASE WHEN occlusion>=.5e0 THEN 1e0 ELSE 0e0 END) AS occlusion_ambiguous_fraction, avg(CASE WHEN uncertainty>=.65e0 THEN 1e0 ELSE 0e0 END) AS high_uncertainty_fraction FROM rel GROUP BY 1,2""")
def reliability_rollup(spark, d):
    return R.reliability_rollup(reliable(spark, d)).withColumn("mean_history_visibility", r6(F.col("mean_history_visibility")))


def affine_sql(mode: str) -> str:
    """CTE ``model`` (vx0..vyy) over wflow."""
    t = R.REPAIR[mode]["trusted"]
    out = f"""as0 AS (SELECT clip_id, frame_no, (x-23.5e0)/24e0 AS nx, (y-15.5e0)/24e0 AS ny, vx, vy, greatest(1e-3, confidence*visibility*(1-.65e0*uncertainty)) AS bw, 1e0 AS rw,
  count(*) OVER (PARTITION BY clip_id, frame_no) AS n FROM wflow WHERE confidence>={t}e0 AND visibility>=.45e0 AND uncertainty<=.65e0)"""
    for i in range(3):
        a = f"as{i}"
        sums = {"s0": "1e0", "sx": "nx", "sy": "ny", "sxx": "nx*nx", "sxy": "nx*ny", "syy": "ny*ny", "u0": "vx", "u1": "vx*nx", "u2": "vx*ny", "w0": "vy", "w1": "vy*nx", "w2": "vy*ny"}
        out += f""",
n{i} AS (SELECT clip_id, frame_no, max(n) AS samples, {', '.join(f'sum(bw*rw*({v})) AS {k}' for k, v in sums.items())} FROM {a} WHERE n>=24 GROUP BY 1,2),
o{i} AS (SELECT *, sxx-sx*sx/s0 AS d22, sxy-sx*sy/s0 AS d23, syy-sy*sy/s0 AS d33, u1-u0*sx/s0 AS ur2, u2-u0*sy/s0 AS ur3, w1-w0*sx/s0 AS wr2, w2-w0*sy/s0 AS wr3 FROM n{i}),
p{i} AS (SELECT *, d33-d23*d23/d22 AS e33 FROM o{i}),
q{i} AS (SELECT *, (ur3-ur2*d23/d22)/e33 AS uc3, (wr3-wr2*d23/d22)/e33 AS wc3 FROM p{i} WHERE s0>=1e-7 AND d22>=1e-7 AND e33>=1e-7),
t{i} AS (SELECT *, (ur2-d23*uc3)/d22 AS uc2, (wr2-d23*wc3)/d22 AS wc2 FROM q{i}),
m{i} AS (SELECT *, (u0-sx*uc2-sy*uc3)/s0 AS uc1, (w0-sx*wc2-sy*wc3)/s0 AS wc1 FROM t{i})"""
        if i < 2:
            out += f""",
z{i} AS (SELECT a.clip_id, a.frame_no, a.nx, a.ny, a.vx, a.vy, a.bw, a.n, sqrt((vx-(uc1+uc2*nx+uc3*ny))**2+(vy-(wc1+wc2*nx+wc3*ny))**2) AS res FROM {a} a JOIN m{i} m ON {on('m', 'a')}),
zm{i} AS (SELECT clip_id, frame_no, median(res) AS med FROM z{i} GROUP BY 1,2),
za{i} AS (SELECT z.clip_id, z.frame_no, max(med) AS med, median(abs(res-med)) AS mad FROM z{i} z JOIN zm{i} m ON {on('m', 'z')} GROUP BY 1,2),
as{i + 1} AS (SELECT clip_id, frame_no, nx, ny, vx, vy, bw, n, CASE WHEN res<=hb THEN 1e0 ELSE hb/greatest(res,1e-5) END AS rw FROM
  (SELECT z.*, greatest(.75e0, med+1.75e0*greatest(.35e0,1.4826e0*mad)) AS hb FROM z{i} z JOIN za{i} a ON {on('a', 'z')}))"""
    return out + ", model AS (SELECT clip_id, frame_no, uc1 AS vx0, uc2 AS vxx, uc3 AS vxy, wc1 AS vy0, wc2 AS vyx, wc3 AS vyy, samples FROM m2)"


@query("e08_fit_affine_motion", with_fixtures("wflow") + "," + affine_sql("auto")
       + " SELECT clip_id, frame_no, " + ", ".join(f"round({c},5)+0e0 AS {c}" for c in ("vx0", "vxx", "vxy", "vy0", "vyx", "vyy")) + ", samples FROM model")
def fit_affine_motion(spark, d):
    m = R.fit_affine_motion(fx.wide_flow(spark, d), 48, 32)
    return m.select("clip_id", "frame_no", *[r6(F.col(c), 5).alias(c) for c in ("vx0", "vxx", "vxy", "vy0", "vyx", "vyy")], "samples")


def repair_sql(mode: str, step: int, depth: bool) -> str:
    """CTE ``rep``: wflow with nvx, nvy, nunc, repaired."""
    k = R.REPAIR[mode]
    gate = f"AND abs(dc.d-dn.d) <= greatest({k['gate']}e0, .05e0*greatest(abs(dc.d),abs(dn.d)))" if depth else ""
    djoin = f"JOIN wdepth dc ON {on('dc', 'c', _K4)} JOIN wdepth dn ON {on('dn', 'n', _K4)}" if depth else ""
    return affine_sql(mode) + f""",
tr AS (SELECT *, confidence*(.55e0+.45e0*visibility)*(1-.58e0*uncertainty) AS trust,
  NOT (confidence>={k['protect']}e0 AND uncertainty<=.24e0 AND visibility>=.72e0) AND confidence*(.55e0+.45e0*visibility)*(1-.58e0*uncertainty) < {k['reject']}e0 AS bad FROM wflow),
ring AS (SELECT r+1 AS r, o.i, o.dx*(r+1)*{step} AS dx, o.dy*(r+1)*{step} AS dy, r*8+o.i AS ord FROM range({k['rings']}) t(r),
  (VALUES (0,-1,0),(1,1,0),(2,0,-1),(3,0,1),(4,-1,-1),(5,1,-1),(6,-1,1),(7,1,1)) o(i,dx,dy)),
nb AS (SELECT c.clip_id, c.frame_no, c.y, c.x, ring.ord, n.vx, n.vy, n.confidence*n.visibility*(1-.65e0*n.uncertainty)/ring.r AS w FROM tr c CROSS JOIN ring
  JOIN wflow n ON {on('n', 'c')} AND n.y=c.y+ring.dy AND n.x=c.x+ring.dx {djoin}
  WHERE c.bad AND n.confidence>={k['reject']}e0 AND n.visibility>={k['min_vis']}e0 AND n.uncertainty<={k['max_unc']}e0 {gate}),
vs AS (SELECT a.clip_id, a.frame_no, a.y, a.x, a.ord, max(a.vx) AS vx, max(a.vy) AS vy, sum(b.w*sqrt((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy))) AS score, count(*) AS cnt, sum(b.w) AS tot
  FROM nb a JOIN nb b ON {on('b', 'a', _K4)} GROUP BY 1,2,3,4,5),
md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY score, ord) AS rn FROM vs) WHERE rn=1 AND cnt>=2),
cu AS (SELECT m.clip_id, m.frame_no, m.y, m.x, sum(n.w*n.vx) AS sx, sum(n.w*n.vy) AS sy, sum(n.w) AS sw, count(*) AS cn, max(m.tot) AS tot FROM md m JOIN nb n ON {on('n', 'm', _K4)}
  AND sqrt((n.vx-m.vx)*(n.vx-m.vx)+(n.vy-m.vy)*(n.vy-m.vy)) <= {k['radius']}e0+{k['radius_slope']}e0*sqrt(m.vx*m.vx+m.vy*m.vy) GROUP BY 1,2,3,4),
ch AS (SELECT t.*, cu.sx/cu.sw AS lx, cu.sy/cu.sw AS ly, coalesce(cu.sw/cu.tot,0e0) AS coh, cu.cn IS NOT NULL AS many, coalesce(cu.cn>=2 AND cu.sw/cu.tot>={k['share']}e0, false) AS loc,
  m.vx0+m.vxx*((t.x-23.5e0)/24e0)+m.vxy*((t.y-15.5e0)/24e0) AS ax, m.vy0+m.vyx*((t.x-23.5e0)/24e0)+m.vyy*((t.y-15.5e0)/24e0) AS ay
  FROM tr t LEFT JOIN cu ON {on('cu', 't', _K4)} LEFT JOIN model m ON {on('m', 't')}),
cc AS (SELECT *, CASE WHEN bad AND loc THEN 'local' WHEN bad AND ax IS NOT NULL AND disocclusion<.45e0 THEN 'affine' END AS repaired,
  {k['blend']}e0*(.35e0+.65e0*{cl(f"({k['reject']}e0-trust)/{k['reject']}e0")}) AS bl FROM ch),
rep AS (SELECT {_C}, vx AS rvx, vy AS rvy, confidence, visibility, uncertainty, disocclusion, occlusion, repaired,
  CASE repaired WHEN 'local' THEN vx+(lx-vx)*bl WHEN 'affine' THEN vx+(ax-vx)*bl ELSE vx END AS nvx, CASE repaired WHEN 'local' THEN vy+(ly-vy)*bl WHEN 'affine' THEN vy+(ay-vy)*bl ELSE vy END AS nvy,
  CASE WHEN repaired IS NOT NULL AND many THEN greatest(disocclusion*.75e0, least(uncertainty, .76e0-.28e0*coh)) ELSE uncertainty END AS nunc FROM cc)"""


_REP_OUT = f" SELECT {_C}, round(nvx,5)+0e0 AS vx, round(nvy,5)+0e0 AS vy, round(nunc,5) AS uncertainty, repaired FROM rep"


def _rep_out(df):
    return df.select(*CELL, *[r6(F.col(c), 5).alias(c) for c in ("vx", "vy", "uncertainty")], "repaired")


@query("e09_repair_rejected_auto", with_fixtures("wflow") + "," + repair_sql("auto", 4, False) + _REP_OUT)
def repair_auto(spark, d):
    return _rep_out(R.repair_rejected(fx.wide_flow(spark, d), 48, 32, "auto", 4))


@query("e09_repair_rejected_strong", with_fixtures("wflow") + "," + repair_sql("strong", 2, False) + _REP_OUT)
def repair_strong(spark, d):
    return _rep_out(R.repair_rejected(fx.wide_flow(spark, d), 48, 32, "strong", 2))


@query("e11_refine_with_depth", with_fixtures("wflow", "wdepth") + "," + repair_sql("auto", 4, True) + _REP_OUT)
def refine_with_depth(spark, d):
    return _rep_out(R.refine_with_depth(fx.wide_flow(spark, d), fx.wide_depth(spark, d), 48, 32, "auto", 4))


def safe_sql(mode: str) -> str:
    """CTE ``safe`` over ``rep``."""
    k = R.SAFE[mode]
    return f"""sa AS (SELECT *, sqrt((nvx-rvx)*(nvx-rvx)+(nvy-rvy)*(nvy-rvy)) AS delta, 1.25e0+.18e0*sqrt(rvx*rvx+rvy*rvy) AS sd, 3e0+.3e0*sqrt(rvx*rvx+rvy*rvy) AS sv,
  confidence*(.45e0+.55e0*visibility)*(1-.4e0*uncertainty) AS arb FROM rep),
sb AS (SELECT *, CASE WHEN arb<{k['protect']}e0 AND delta>.05e0 THEN {k['blend']}e0*(.22e0+.78e0*{cl(f"({k['below']}e0-arb)/{k['below']}e0")})
  *(.45e0+.55e0*{cl('1-greatest(0e0,delta-sd)/greatest(1e0,sv)')})*CASE WHEN arb>{k['below']}e0 THEN .35e0 ELSE 1e0 END*(.55e0+.45e0*(1-disocclusion)) ELSE 0e0 END AS bl FROM sa),
sc2 AS (SELECT *, bl>.02e0 AS corrected, CASE WHEN bl>.02e0 THEN rvx+(nvx-rvx)*bl ELSE rvx END AS vx, CASE WHEN bl>.02e0 THEN rvy+(nvy-rvy)*bl ELSE rvy END AS vy,
  confidence*visibility*(1-.65e0*uncertainty)*(1-.35e0*occlusion)*CASE WHEN delta>sd THEN 1-.7e0*{cl('(delta-sd)/greatest(1e0,sv-sd)')} ELSE 1e0 END AS h0 FROM sb),
sd2 AS (SELECT *, CASE WHEN confidence<{k['hard']}e0 THEN least(h0,{k['floor']}e0) ELSE h0 END AS h1 FROM sc2),
safe AS (SELECT {_C}, vx, vy, corrected, CASE WHEN x+vx<0 OR y+vy<0 OR x+vx>47 OR y+vy>31 OR disocclusion>=.8e0 OR visibility<=.1e0 THEN 0e0
  WHEN disocclusion>=.5e0 THEN least(h1,.04e0) ELSE {cl('h1')} END AS hc FROM sd2)"""


_SAFE_OUT = f" SELECT {_C}, round(vx,5)+0e0 AS vx, round(vy,5)+0e0 AS vy, round(hc,5) AS confidence, corrected, hc<.08e0 AS rejected FROM safe"


def _safe(spark, d, mode, step):
    f = fx.wide_flow(spark, d).withColumns({"raw_vx": F.col("vx"), "raw_vy": F.col("vy")})
    s = R.safe_motion(f, 48, 32, mode, step)
    return s.select(*CELL, *[r6(F.col(c), 5).alias(c) for c in ("vx", "vy", "confidence")], "corrected", "rejected")


@query("e10_safe_motion_auto", with_fixtures("wflow") + "," + repair_sql("auto", 4, False) + "," + safe_sql("auto") + _SAFE_OUT)
def safe_auto(spark, d):
    return _safe(spark, d, "auto", 4)


@query("e10_safe_motion_strong", with_fixtures("wflow") + "," + repair_sql("strong", 2, False) + "," + safe_sql("strong") + _SAFE_OUT)
def safe_strong(spark, d):
    return _safe(spark, d, "strong", 2)
