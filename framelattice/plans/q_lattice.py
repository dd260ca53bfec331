"""Queries over lattice lookups, resampling and neighbour operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..functions import colour as K
from ..operators import lattice as L
from ..operators import preview as P
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .q_scalars import hsv_sql
from .registry import query
from .sqltext import LUMA, bilinear, filled, nine_join, on, previous

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"


def luma_cells(spark, d, wide=False):
    p = fx.wide_px(spark, d) if wide else fx.px(spark, d)
    return p.select(*CELL, K.luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))


LUMA_CTE = f"lum AS (SELECT {_C}, {LUMA} AS l FROM px)"
WLUMA_CTE = f"wlum AS (SELECT {_C}, {LUMA} AS l FROM wpx)"


@query("c01_pair_previous", with_fixtures("px") + " " + filled(
    "px", "(SELECT clip_id, frame_no+1 AS frame_no, y, x, r AS prev_r, g AS prev_g FROM px)", ["r"], ["prev_r", "prev_g"]))
def pair_previous(spark, d):
    return L.pair_previous(fx.px(spark, d).select(*CELL, "r", "g"), ["r", "g"]).drop("g")


@query("c02_resample_nearest_down", with_fixtures("wpx") + """
SELECT p.clip_id, p.frame_no, ty.y, tx.x, p.r FROM wpx p JOIN range(13) ty(y) ON p.y = CAST(floor(ty.y*32/13e0) AS BIGINT)
JOIN range(20) tx(x) ON p.x = CAST(floor(tx.x*48/20e0) AS BIGINT)""")
def resample_nearest_down(spark, d):
    return L.resample_nearest(fx.wide_px(spark, d).select(*CELL, "r"), 48, 32, 20, 13)


@query("c02_resample_nearest_up", with_fixtures("px") + """
SELECT p.clip_id, p.frame_no, ty.y, tx.x, p.r FROM px p JOIN range(12) ty(y) ON p.y = CAST(floor(ty.y*8/12e0) AS BIGINT)
JOIN range(20) tx(x) ON p.x = CAST(floor(tx.x*8/20e0) AS BIGINT)""")
def resample_nearest_up(spark, d):
    return L.resample_nearest(fx.px(spark, d).select(*CELL, "r"), 8, 8, 20, 12)


@query("c03_resample_bilinear", with_fixtures("flow") + """,
tg AS (SELECT clip_id, frame_no, ty.y, tx.x FROM (SELECT DISTINCT clip_id, frame_no FROM flow) f, range(16) ty(y), range(20) tx(x)),"""
       + bilinear("up", "tg", "flow", {"vx": "vx", "confidence": "confidence"}, "(x+0.5e0)*(8/20e0)-0.5e0", "(y+0.5e0)*(8/16e0)-0.5e0", 8, 8)
       + " SELECT clip_id, frame_no, y, x, round(vx*2.5e0,9)+0e0 AS vx, round(confidence,9) AS confidence FROM up")
def resample_bilinear(spark, d):
    out = L.resample_bilinear(fx.flow(spark, d), ["vx", "confidence"], 8, 8, 20, 16, {"vx": 2.5})
    return out.select(*CELL, r6(F.col("vx"), 9).alias("vx"), r6(F.col("confidence"), 9).alias("confidence"))


@query("c03_resample_depth", with_fixtures("tile") + """,
tg AS (SELECT vec_id, ty.y, tx.x FROM (SELECT DISTINCT vec_id FROM tile) f, range(5) ty(y), range(11) tx(x)),"""
       + bilinear("up", "tg", "tile", {"v": "v"}, "(x+0.5e0)*(8/11e0)-0.5e0", "(y+0.5e0)*(8/5e0)-0.5e0", 8, 8, keys=("vec_id",))
       + " SELECT vec_id, y, x, round(v,6)+0e0 AS v FROM up")
def resample_depth(spark, d):
    out = L.resample_bilinear(fx.tile(spark, d), ["v"], 8, 8, 11, 5, keys=("vec_id",))
    return out.select("vec_id", "y", "x", r6(F.col("v")).alias("v"))


_WARP = with_fixtures("px", "flow") + "," + LUMA_CTE + "," + previous("prev", "lum") + ","


def _warp(spark, d, border, access="planes"):
    f = fx.flow(spark, d).select(*CELL, "vx", "vy")
    return L.warp_lookup(f, luma_cells(spark, d), {"l": "pl"}, 8, 8, border, access=access)


def _warp_sql(base: str = "flow", more: str = "", **how) -> str:
    found = _WARP + bilinear("w", "flow", "prev", {"l": "pl"}, "x+vx", "y+vy", 8, 8, how="JOIN", **how)
    cols = ["vx", "vy"] + ([more] if more else [])
    return found + f" SELECT {_C}, {', '.join(cols)}, round(pl,6) AS pl FROM (" + filled(base, "w", cols, ["pl"]) + ")"


@query("c04_warp_reject", _warp_sql(reject=True))
def warp_reject(spark, d):
    return _warp(spark, d, "reject").withColumn("pl", r6(F.col("pl")))


@query("c04_warp_clamp", _warp_sql())
def warp_clamp(spark, d):
    return _warp(spark, d, "clamp").withColumn("pl", r6(F.col("pl")))


@query("c04_warp_flag_rows", _warp_sql("(SELECT *, x+vx>=0 AND y+vy>=0 AND x+vx<=7 AND y+vy<=7 AS inside FROM flow)", "inside"))
def warp_flag_rows(spark, d):
    """The same lookup through row pairs, the way of frames too large for a task."""
    return _warp(spark, d, "flag", "rows").withColumn("pl", r6(F.col("pl")))


def _nearest_sql(border: str) -> str:
    ok = "q.sx>=0 AND q.sy>=0 AND q.sx<=7 AND q.sy<=7" if border == "zero" else "true"
    return with_fixtures("px", "flow") + f""",
q AS (SELECT {_C}, vx, vy, x+vx*0.5e0 AS sx, y+vy*0.5e0 AS sy FROM flow),
f AS (SELECT q.clip_id, q.frame_no, q.y, q.x, s.r AS found FROM q JOIN px s ON {on('s', 'q')}
 AND s.y=CAST(least(greatest(round(q.sy),0),7) AS BIGINT) AND s.x=CAST(least(greatest(round(q.sx),0),7) AS BIGINT))
SELECT {_C}, CASE WHEN {ok.replace('q.', '')} THEN found ELSE 0 END AS pr FROM ({filled('q', 'f', ['sx', 'sy'], ['found'])})"""


def _nearest(spark, d, border):
    q = fx.flow(spark, d).select(*CELL, (F.col("x") + F.col("vx") * 0.5).alias("sx"), (F.col("y") + F.col("vy") * 0.5).alias("sy"))
    return L.nearest_lookup(q, fx.px(spark, d), {"r": "pr"}, "sx", "sy", 8, 8, border, outside_value=0).drop("sx", "sy")


@query("c05_nearest_clamp", _nearest_sql("clamp"))
def nearest_clamp(spark, d):
    return _nearest(spark, d, "clamp")


@query("c05_nearest_zero", _nearest_sql("zero"))
def nearest_zero(spark, d):
    return _nearest(spark, d, "zero")


def down_sql(name: str, src: str, w: int, h: int, cols=("r", "g", "b")) -> str:
    k = "CASE abs(o) WHEN 2 THEN 1 WHEN 1 THEN 4 ELSE 6 END"
    return f"""{name}_h AS (SELECT c.clip_id, c.frame_no, c.y, CAST(c.x//2 AS BIGINT) AS x, {', '.join(f'CAST(sum(n.{c}*({k})) AS BIGINT) AS {c}' for c in cols)}
 FROM {src} c CROSS JOIN (SELECT i-2 AS o FROM range(5) t(i)) JOIN {src} n ON {on('n', 'c')} AND n.y=c.y AND n.x=least(greatest(c.x+o,0),{w}-1)
 WHERE c.x%2=0 GROUP BY c.clip_id, c.frame_no, c.y, c.x),
{name} AS (SELECT c.clip_id, c.frame_no, CAST(c.y//2 AS BIGINT) AS y, c.x, {', '.join(f'(CAST(sum(n.{c}*({k})) AS BIGINT)+128)>>8 AS {c}' for c in cols)}
 FROM {name}_h c CROSS JOIN (SELECT i-2 AS o FROM range(5) t(i)) JOIN {name}_h n ON {on('n', 'c')} AND n.x=c.x AND n.y=least(greatest(c.y+o,0),{h}-1)
 WHERE c.y%2=0 GROUP BY c.clip_id, c.frame_no, c.y, c.x)"""


@query("c06_pyramid_half", with_fixtures("wpx") + "," + down_sql("half", "wpx", 48, 32) + f" SELECT {_C}, r, g, b FROM half")
def pyramid_half(spark, d):
    return L.pyramid_down(fx.wide_px(spark, d), ["r", "g", "b"], 1)


@query("c06_pyramid_quarter", with_fixtures("wpx") + "," + down_sql("half", "wpx", 48, 32) + "," + down_sql("quarter", "half", 24, 16)
       + f" SELECT {_C}, r, g, b FROM quarter")
def pyramid_quarter(spark, d):
    return L.pyramid_down(fx.wide_px(spark, d), ["r", "g", "b"], 2)


@query("c07_neighborhood_stats", with_fixtures("px") + "," + nine_join(
    "s", "px", "min(n.r) AS local_min, max(n.r) AS local_max, sum(n.r)/9e0 AS m, sum(n.r*n.r)/9e0 AS q", 8, 8)
       + f" SELECT {_C}, local_min, local_max, round(m,6) AS local_mean, round(greatest(0e0, q-m*m),4) AS local_var FROM s")
def neighborhood_stats(spark, d):
    return L.neighborhood_stats(fx.px(spark, d).select(*CELL, "r"), "r").select(
        *CELL, "local_min", "local_max", r6(F.col("local_mean")).alias("local_mean"), r6(F.col("local_var"), 4).alias("local_var"))


_EDGE_W = "(CASE abs(o.dy)+abs(o.dx) WHEN 0 THEN 1e0 WHEN 1 THEN .72e0 ELSE .52e0 END * exp(-abs(n.l-c.l)/{s}e0))"


@query("c08_edge_aware_mean", with_fixtures("px") + f", lum AS (SELECT {_C}, r, g, (.25e0*r+.5e0*g+.25e0*b)/255e0 AS l FROM px),"
       + nine_join("s", "lum", f"sum(n.r*{_EDGE_W.format(s='.0792')})/sum({_EDGE_W.format(s='.0792')}) AS rm, "
                   f"sum(n.g*{_EDGE_W.format(s='.0792')})/sum({_EDGE_W.format(s='.0792')}) AS gm", 8, 8)
       + f" SELECT {_C}, round(rm,6) AS r_mean, round(gm,6) AS g_mean FROM s")
def edge_aware_mean(spark, d):
    p = fx.px(spark, d)
    p = p.select(*CELL, "r", "g", (K.rgb_to_ycocg(F.col("r"), F.col("g"), F.col("b"))["y"] / 255.0).alias("l"))
    return L.edge_aware_mean(p, "l", ["r", "g"], 0.72).select(*CELL, r6(F.col("r_mean")).alias("r_mean"), r6(F.col("g_mean")).alias("g_mean"))


@query("c09_median3x3", with_fixtures("flow") + "," + nine_join("s", "flow", "median(n.vx) AS vx_med, median(n.vy) AS vy_med", 8, 8)
       + f" SELECT {_C}, vx_med, vy_med FROM s")
def median3x3(spark, d):
    return L.median3x3(fx.flow(spark, d), ["vx", "vy"]).select(*CELL, "vx_med", "vy_med")


@query("c09_gauss3x3", with_fixtures("flow") + "," + nine_join(
    "s", "flow", "sum(n.confidence*(2-abs(o.dy))*(2-abs(o.dx))/16e0) AS b", 8, 8, edge="reflect") + f" SELECT {_C}, round(b,6) AS blur FROM s")
def gauss3x3(spark, d):
    return L.gauss3x3(fx.flow(spark, d), "confidence").select(*CELL, r6(F.col("confidence_blur")).alias("blur"))


def landing_sql(name: str, vx: str, vy: str, gw: int, gh: int, w: int, h: int, src: str = "grid") -> str:
    px, py = f"({w}/{gw}e0)", f"({h}/{gh}e0)"
    return f"""{name}_p AS (SELECT clip_id, frame_no, (gx+.5e0)*{px}-.5e0+{vx} AS dx, (gy+.5e0)*{py}-.5e0+{vy} AS dy FROM {src}),
{name}_t AS (SELECT clip_id, frame_no, (dx+.5e0)/{px}-.5e0 AS tx, (dy+.5e0)/{py}-.5e0 AS ty FROM {name}_p WHERE dx>=0 AND dy>=0 AND dx<={w}-1 AND dy<={h}-1),
{name}_s AS (SELECT clip_id, frame_no, CAST(floor(tx) AS BIGINT)+ox AS gx, CAST(floor(ty) AS BIGINT)+oy AS gy,
  (CASE ox WHEN 1 THEN tx-floor(tx) ELSE 1-(tx-floor(tx)) END)*(CASE oy WHEN 1 THEN ty-floor(ty) ELSE 1-(ty-floor(ty)) END) AS w
  FROM {name}_t, range(2) a(ox), range(2) b(oy)),
{name} AS (SELECT g.clip_id, g.frame_no, g.gy, g.gx, coalesce(sum(s.w),0e0) AS coverage FROM {src} g
  LEFT JOIN {name}_s s ON {on('s', 'g')} AND s.gy=g.gy AND s.gx=g.gx GROUP BY 1,2,3,4)"""


@query("c10_landing_coverage", with_fixtures("grid") + "," + landing_sql("land", "fx/32e0", "fy/32e0", 4, 4, 8, 8)
       + " SELECT clip_id, frame_no, gy, gx, round(coverage,6) AS coverage FROM land")
def landing_coverage(spark, d):
    g = fx.grid(spark, d).select("clip_id", "frame_no", "gy", "gx", K.decode_fixed(F.col("fx")).alias("vx"), K.decode_fixed(F.col("fy")).alias("vy"))
    return L.landing_coverage(g, "vx", "vy", 4, 4, 8, 8).withColumn("coverage", r6(F.col("coverage")))


def invert_sql(src: str, w: int, h: int, prefix: str = "it") -> str:
    """Four unrolled fixed-point steps over forward field ``src`` (vx, vy); CTE ``inverted``."""
    out = f"{prefix}0 AS (SELECT {_C}, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, true AS valid FROM {src})"
    for i in range(4):
        out += "," + bilinear(f"{prefix}s{i}", f"{prefix}{i}", src, {"vx": "gx", "vy": "gy"}, "px", "py", w, h, flag="ins")
        out += f""",{prefix}{i + 1} AS (SELECT {_C}, CASE WHEN valid AND ins THEN x-gx ELSE px END AS px,
  CASE WHEN valid AND ins THEN y-gy ELSE py END AS py, valid AND ins AS valid FROM {prefix}s{i})"""
    return out + f",inverted AS (SELECT {_C}, CASE WHEN valid THEN px-x END AS vx, CASE WHEN valid THEN py-y END AS vy, valid FROM {prefix}4)"


@query("c11_invert_flow", with_fixtures("wflow") + "," + invert_sql("wflow", 48, 32)
       + f" SELECT {_C}, round(vx,6)+0e0 AS vx, round(vy,6)+0e0 AS vy, valid FROM inverted")
def invert_flow(spark, d):
    out = L.invert_flow(fx.wide_flow(spark, d), 48, 32)
    return out.select(*CELL, r6(F.col("vx")).alias("vx"), r6(F.col("vy")).alias("vy"), "valid")


@query("c14_sample_lattice", with_fixtures("wflow") + """,
pt AS (SELECT gy, gx, CAST(round(least(31e0,(gy+.5e0)*3-.5e0)) AS BIGINT) AS y, CAST(round(least(47e0,(gx+.5e0)*3-.5e0)) AS BIGINT) AS x
  FROM range(11) a(gy), range(16) b(gx))
SELECT f.clip_id, f.frame_no, pt.gy, pt.gx, f.vx, f.vy, f.confidence FROM wflow f JOIN pt ON pt.y=f.y AND pt.x=f.x""")
def sample_lattice(spark, d):
    return L.sample_lattice(fx.wide_flow(spark, d).select(*CELL, "vx", "vy", "confidence"), 48, 32, 3)


@query("c15_spread_correction", with_fixtures("flow", "grid") + """,
delta AS (SELECT clip_id, frame_no, gy AS y, gx AS x, fx/32e0 AS dx, bx/64e0 AS dy, CASE WHEN fx<-32 THEN .5e0 ELSE 0e0 END AS weight FROM grid),"""
       + bilinear("s", "(SELECT clip_id, frame_no, y, x FROM flow)", "delta", {"dx": "dx", "dy": "dy", "weight": "weight"},
                  "(x+.5e0)/2e0-.5e0", "(y+.5e0)/2e0-.5e0", 4, 4, flag="ins")
       + f""" SELECT {_C}, CASE WHEN ins AND weight>.001e0 THEN round(dx,6)+0e0 ELSE 0e0 END AS dx,
 CASE WHEN ins AND weight>.001e0 THEN round(dy,6)+0e0 ELSE 0e0 END AS dy, CASE WHEN ins AND weight>.001e0 THEN round(weight,6) ELSE 0e0 END AS weight FROM s""")
def spread_correction(spark, d):
    delta = fx.grid(spark, d).select("clip_id", "frame_no", "gy", "gx", (F.col("fx") / 32.0).alias("dx"), (F.col("bx") / 64.0).alias("dy"),
                                     F.when(F.col("fx") < -32, 0.5).otherwise(0.0).alias("weight"))
    out = L.spread_correction(fx.flow(spark, d).select(*CELL), delta, 8, 8, 2)
    return out.select(*CELL, *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "weight")])


@query("c16_motion_preview", with_fixtures("wflow") + f""",
m AS (SELECT clip_id, frame_no, sqrt(vx*vx*4+vy*vy*.25e0) AS mag, row_number() OVER (PARTITION BY clip_id, frame_no ORDER BY sqrt(vx*vx*4+vy*vy*.25e0)) AS rn FROM wflow),
sc AS (SELECT clip_id, frame_no, greatest(.25e0, mag) AS s FROM m WHERE rn = CAST(floor((1536-1)*.95e0) AS BIGINT)+1),
small AS (SELECT f.clip_id, f.frame_no, ty.y, tx.x, f.vx*2 AS vx, f.vy*.5e0 AS vy FROM wflow f
  JOIN range(16) ty(y) ON f.y=CAST(floor(ty.y*32/16e0) AS BIGINT) JOIN range(24) tx(x) ON f.x=CAST(floor(tx.x*48/24e0) AS BIGINT)),
src AS (SELECT a.*, sc.s FROM small a JOIN sc ON {on('sc', 'a')}),""" + hsv_sql("src", _C) + f" SELECT {_C}, r, g, b FROM hsv")
def motion_preview(spark, d):
    return P.motion_preview(fx.wide_flow(spark, d), 48, 32, 2.0, 0.5, 24).select(*CELL, "r", "g", "b")
