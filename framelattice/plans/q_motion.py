"""Queries over motion estimation, confidence, conditioning and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..operators import lattice as L
from ..operators import motion as M
from ..operators.pairs import flow_stats, scene_segments, stability_gates
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .q_lattice import WLUMA_CTE
from .q_pairs import CUT, GRAY_CTE, STATS_SQL, WGRAY_CTE, cut_sql, gray8, scores
from .registry import query
from .sqltext import bilinear, cl, filled, nine_join, on, previous

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"
_K4 = ("clip_id", "frame_no", "y", "x")

MATCH_SQL = f"""blk AS (SELECT gy, gx, least(31, gy*8+4) AS cy, least(47, gx*8+4) AS cx FROM range(4) a(gy), range(6) b(gx)),
off AS (SELECT i-6 AS dy, j-6 AS dx, i*13+j AS ord FROM range(13) a(i), range(13) b(j)),
smp AS (SELECT 2*i-4 AS oy, 2*j-4 AS ox FROM range(5) a(i), range(5) b(j)),
cs AS (SELECT g.clip_id, g.frame_no, b.gy, b.gx, b.cy, b.cx, g.y, g.x, g.v FROM blk b CROSS JOIN smp s JOIN gray g ON g.y=b.cy+s.oy AND g.x=b.cx+s.ox),
sad AS (SELECT c.clip_id, c.frame_no, c.gy, c.gx, o.ord, o.dy, o.dx, sum(abs(c.v-p.v))/(count(*)*255e0) AS raw FROM cs c CROSS JOIN off o
  JOIN gray p ON p.clip_id=c.clip_id AND p.frame_no=c.frame_no-1 AND p.y=c.y+o.dy AND p.x=c.x+o.dx
  WHERE c.cy+o.dy BETWEEN 0 AND 31 AND c.cx+o.dx BETWEEN 0 AND 47 GROUP BY 1,2,3,4,5,6,7),
rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_no, gy, gx ORDER BY raw, ord) AS r,
  row_number() OVER (PARTITION BY clip_id, frame_no, gy, gx ORDER BY raw+.0015e0*sqrt(CAST(dy*dy+dx*dx AS DOUBLE)), ord) AS w FROM sad),
bm AS (SELECT clip_id, frame_no, gy, gx, max(raw) FILTER (WHERE r=1) AS best, max(raw) FILTER (WHERE r=2) AS sec, CAST(max(dx) FILTER (WHERE w=1) AS DOUBLE) AS vx,
  CAST(max(dy) FILTER (WHERE w=1) AS DOUBLE) AS vy FROM rk GROUP BY 1,2,3,4),
mg AS (SELECT clip_id, frame_no, gy, gx, vx, vy, sqrt(CASE WHEN sec>1e-5 THEN {cl('(sec-best)/sec')} ELSE 0e0 END * {cl('1-best*2.5e0')}) AS confidence FROM bm)"""


def blocks(spark, d):
    return M.block_match(gray8(spark, d, True), 48, 32)


@query("e01_block_match", with_fixtures("wpx") + "," + WGRAY_CTE + "," + MATCH_SQL
       + " SELECT clip_id, frame_no, gy, gx, vx, vy, round(confidence,6) AS confidence FROM mg")
def block_match(spark, d):
    return blocks(spark, d).withColumn("confidence", r6(F.col("confidence")))


def _fill_sql() -> str:
    out, src = "", "mg"
    for i in (1, 2, 3):
        out += f""",s{i} AS (SELECT c.clip_id, c.frame_no, c.gy, c.gx, sum(n.vx*n.confidence) AS sx, sum(n.vy*n.confidence) AS sy, sum(n.confidence) AS sw, max(n.confidence) AS mw
  FROM {src} c JOIN {src} n ON {on('n', 'c')} AND abs(n.gy-c.gy)<=1 AND abs(n.gx-c.gx)<=1 AND NOT (n.gy=c.gy AND n.gx=c.gx) AND n.confidence>=.18e0 GROUP BY 1,2,3,4),
f{i} AS (SELECT c.clip_id, c.frame_no, c.gy, c.gx, CASE WHEN c.confidence<.18e0 AND s.sw>0 THEN sx/sw ELSE vx END AS vx, CASE WHEN c.confidence<.18e0 AND s.sw>0 THEN sy/sw ELSE vy END AS vy,
  CASE WHEN c.confidence<.18e0 AND s.sw>0 THEN mw*.55e0 ELSE confidence END AS confidence FROM {src} c LEFT JOIN s{i} s ON {on('s', 'c', ('clip_id', 'frame_no', 'gy', 'gx'))})"""
        src = f"f{i}"
    return out


@query("e02_fill_low_confidence", with_fixtures("wpx") + "," + WGRAY_CTE + "," + MATCH_SQL + _fill_sql()
       + " SELECT clip_id, frame_no, gy, gx, round(vx,6)+0e0 AS vx, round(vy,6)+0e0 AS vy, round(confidence,6) AS confidence FROM f3")
def fill_low_confidence(spark, d):
    g = M.fill_low_confidence(blocks(spark, d))
    return g.select("clip_id", "frame_no", "gy", "gx", *[r6(F.col(c)).alias(c) for c in ("vx", "vy", "confidence")])


@query("e02_dense_block_flow", with_fixtures("wpx") + "," + WGRAY_CTE + "," + MATCH_SQL + _fill_sql() + "," + cut_sql("gray") + ","
       + bilinear("up", f"(SELECT {_C} FROM wpx)", "(SELECT clip_id, frame_no, gy AS y, gx AS x, vx, vy, confidence FROM f3)",
                  {"vx": "vx", "vy": "vy", "confidence": "confidence"}, "((x+.5e0)-.5e0-4e0)/8e0", "((y+.5e0)-.5e0-4e0)/8e0", 6, 4)
       + f""" SELECT u.clip_id, u.frame_no, u.y, u.x, CASE WHEN s.cut THEN 0e0 ELSE round(u.vx,6)+0e0 END AS vx, CASE WHEN s.cut THEN 0e0 ELSE round(u.vy,6)+0e0 END AS vy,
 CASE WHEN s.cut THEN 0e0 ELSE round({cl('u.confidence')},6) END AS confidence FROM up u JOIN segments s ON {on('s', 'u')}""")
def dense_block_flow(spark, d):
    """The whole estimator: search, fill, upsample, and no motion across cuts."""
    g = M.fill_low_confidence(blocks(spark, d))
    up = M.upsample_blocks(g, fx.wide_px(spark, d), 48, 32, 48, 32)
    out = M.void_cuts(up, scene_segments(scores(spark, d, wide=True), CUT))
    return out.select(*CELL, *[r6(F.col(c)).alias(c) for c in ("vx", "vy", "confidence")])


def backward(spark, d):
    """A backward field that mostly undoes the forward one."""
    return fx.flow(spark, d).select(*CELL, (-F.col("vx")).alias("vx"), F.lit(0.25).alias("vy"))


CONF_SQL = (previous("pg", "gray") + f",back AS (SELECT {_C}, -vx AS vx, .25e0 AS vy FROM flow),"
            + bilinear("w1", f"(SELECT {_C}, vx, vy FROM flow)", "pg", {"v": "pv"}, "x+vx", "y+vy", 8, 8, flag="ins") + ","
            + bilinear("w2", "w1", "back", {"vx": "bx", "vy": "by_"}, "x+vx", "y+vy", 8, 8)
            + f""",ce AS (SELECT w2.clip_id, w2.frame_no, w2.y, w2.x, w2.vx, w2.vy, CASE WHEN ins AND pv IS NOT NULL THEN 1e0 ELSE 0e0 END AS ok,
  coalesce(exp(-abs(g.v-pv)/24e0)*exp(-sqrt((vx+bx)*(vx+bx)+(vy+by_)*(vy+by_))/1.75e0),0e0)*CASE WHEN ins AND pv IS NOT NULL THEN 1e0 ELSE 0e0 END AS c
  FROM w2 JOIN gray g ON {on('g', 'w2', _K4)}),"""
            + nine_join("bl", "ce", "sum(n.c*(2-abs(o.dy))*(2-abs(o.dx))/16e0) AS b", 8, 8, edge="reflect"))


@query("e03_bidirectional_confidence", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + CONF_SQL
       + f" SELECT c.clip_id, c.frame_no, c.y, c.x, c.vx, c.vy, round({cl('b.b*c.ok')},6) AS confidence FROM ce c JOIN bl b ON {on('b', 'c', _K4)}")
def bidirectional_confidence(spark, d):
    out = M.bidirectional_confidence(fx.flow(spark, d), backward(spark, d), gray8(spark, d), 8, 8)
    return out.withColumn("confidence", r6(F.col("confidence")))


@query("e04_zero_duplicate_frames", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + STATS_SQL + f""",
dup AS (SELECT clip_id, frame_no FROM stats WHERE mad < .1e0),
zc AS (SELECT a.clip_id, a.frame_no, a.y, a.x, exp(-abs(a.v-b.v)/18e0) AS c FROM gray a JOIN gray b ON b.clip_id=a.clip_id AND b.frame_no=a.frame_no-1 AND b.y=a.y AND b.x=a.x JOIN dup ON {on('dup', 'a')}),"""
       + nine_join("zb", "zc", "sum(n.c*(2-abs(o.dy))*(2-abs(o.dx))/16e0) AS b", 8, 8, edge="reflect")
       + f""" SELECT {_C}, CASE WHEN b IS NULL THEN vx ELSE 0e0 END AS vx, CASE WHEN b IS NULL THEN vy ELSE 0e0 END AS vy,
 round(CASE WHEN b IS NULL THEN confidence ELSE {cl('b')} END,6) AS confidence FROM ({filled('flow', 'zb', ['vx', 'vy', 'confidence'], ['b'])})""")
def zero_duplicate_frames(spark, d):
    """Every frame whose mean change is below a tenth counts as a duplicate here; real clips use the gate of d07."""
    g, f = gray8(spark, d), fx.flow(spark, d).select(*CELL, "vx", "vy", "confidence")
    gates = flow_stats(fx.flow(spark, d), g).select("clip_id", "frame_no", (F.col("mad") < 0.1).alias("near_duplicate"))
    return M.zero_duplicate_frames(f, g, gates).withColumn("confidence", r6(F.col("confidence")))


_HELD = GRAY_CTE.replace("gray AS", "gray0 AS") + """,
gray AS (SELECT clip_id, frame_no+k AS frame_no, y, x, v FROM gray0 CROSS JOIN range(2) t(k) WHERE frame_no%2=0),
still AS (SELECT clip_id, frame_no, y, x, vx*.02e0 AS vx, vy*.02e0 AS vy, confidence FROM flow),"""


@query("e04_zero_duplicates_by_gate", with_fixtures("px", "flow") + "," + _HELD + STATS_SQL.replace("FROM flow f", "FROM still f") + f""",
dup AS (SELECT clip_id, frame_no FROM stats WHERE mad<.01e0 AND changed_ratio<.02e0 AND p50<.12e0 AND p95<1.5e0),
zc AS (SELECT a.clip_id, a.frame_no, a.y, a.x, exp(-abs(a.v-b.v)/18e0) AS c FROM gray a JOIN gray b ON b.clip_id=a.clip_id AND b.frame_no=a.frame_no-1 AND b.y=a.y AND b.x=a.x JOIN dup ON {on('dup', 'a')}),"""
       + nine_join("zb", "zc", "sum(n.c*(2-abs(o.dy))*(2-abs(o.dx))/16e0) AS b", 8, 8, edge="reflect")
       + f""" SELECT {_C}, CASE WHEN b IS NULL THEN vx ELSE 0e0 END AS vx, CASE WHEN b IS NULL THEN vy ELSE 0e0 END AS vy,
 round(CASE WHEN b IS NULL THEN confidence ELSE {cl('b')} END,6) AS confidence FROM ({filled('still', 'zb', ['vx', 'vy', 'confidence'], ['b'])})""")
def zero_duplicates_by_gate(spark, d):
    """The gate itself, on clips in which every other frame is held for two and little moves."""
    even = gray8(spark, d).where("frame_no % 2 = 0")
    g = even.withColumn("frame_no", F.explode(F.array("frame_no", F.col("frame_no") + 1)))
    f = fx.flow(spark, d).select(*CELL, (F.col("vx") * 0.02).alias("vx"), (F.col("vy") * 0.02).alias("vy"), "confidence")
    return M.zero_duplicate_frames(f, g, stability_gates(flow_stats(f, g))).withColumn("confidence", r6(F.col("confidence")))


@query("e05_condition_outliers", with_fixtures("flow") + "," + nine_join("md", "flow", "median(n.vx) AS mx, median(n.vy) AS my", 8, 8) + f""",
j AS (SELECT f.*, mx, my, CASE WHEN confidence<.35e0 AND sqrt((vx-mx)*(vx-mx)+(vy-my)*(vy-my)) > .75e0+.25e0*sqrt(mx*mx+my*my)
  THEN {cl('(.35e0-confidence)/.35e0')} ELSE 0e0 END AS b FROM flow f JOIN md ON {on('md', 'f', _K4)})
SELECT {_C}, round(vx*(1-b)+mx*b,6)+0e0 AS vx, round(vy*(1-b)+my*b,6)+0e0 AS vy FROM j""")
def condition_outliers(spark, d):
    out = M.condition_outliers(fx.flow(spark, d))
    return out.select(*CELL, r6(F.col("vx")).alias("vx"), r6(F.col("vy")).alias("vy"))


def _motion_files(spark, d):
    """Motion file cells with x void (NaN) where the data channel says 6."""
    c = fx.motion_chan(spark, d)
    r = c.where("channel = 'R'").select(F.col("seq_id").alias("clip_id"), "frame_no", "y", "x", F.col("value").alias("mx"))
    b = c.where("channel = 'B'").select(F.col("seq_id").alias("clip_id"), "frame_no", "y", "x", F.col("value").alias("b"))
    return r.join(b, CELL).select(*CELL, F.when(F.col("b") == 0.75, float("nan")).otherwise(F.col("mx")).alias("mx"),
                                  (F.col("b") * 0.5).alias("my"))


_FILES = "fld AS (SELECT clip_id, frame_no, y, x, CASE WHEN n=6 THEN 'nan'::DOUBLE WHEN n=7 THEN 3e0 ELSE 1e0 END AS mx, n/16e0 AS my FROM wraster)"
_EXT_TAIL = (previous("pl", "wlum") + "," + bilinear("w", "m", "pl", {"l": "pl"}, "x+vx", "y+vy", 48, 32, reject=True) + f"""
SELECT w.clip_id, w.frame_no, w.y, w.x, round(w.vx,6)+0e0 AS vx, round(w.vy,6)+0e0 AS vy,
 CASE WHEN w.ok AND w.pl IS NOT NULL THEN round(least(exp(-5e0*abs(l.l-w.pl)/255e0),1e0),6) ELSE 0e0 END AS confidence FROM w JOIN wlum l ON {on('l', 'w', _K4)}""")


def _ext(spark, d, direction):
    f = M.import_external_motion(_motion_files(spark, d), fx.wide_px(spark, d), 48, 32, 1.0, 1.0, False, True, direction)
    return f.select(*CELL, *[r6(F.col(c)).alias(c) for c in ("vx", "vy", "confidence")])


@query("e06_import_external_motion", with_fixtures("wpx") + "," + WLUMA_CTE + "," + _FILES + f""",
m AS (SELECT {_C}, CASE WHEN isfinite(mx) THEN mx ELSE 0e0 END AS vx, CASE WHEN isfinite(mx) THEN -my ELSE 0e0 END AS vy, isfinite(mx) AS ok FROM fld),""" + _EXT_TAIL)
def import_external_motion(spark, d):
    return _ext(spark, d, "current_to_previous")


def _forward_sql() -> str:
    out = f"fw AS (SELECT clip_id, frame_no+1 AS frame_no, y, x, mx AS vx, CASE WHEN isfinite(mx) THEN -my ELSE 'nan'::DOUBLE END AS vy FROM fld WHERE frame_no<6)"
    out += f",it0 AS (SELECT {_C}, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, true AS valid FROM fw)"
    for i in range(4):
        out += "," + bilinear(f"its{i}", f"it{i}", "fw", {"vx": "gx", "vy": "gy"}, "px", "py", 48, 32, flag="ins")
        ok = "valid AND ins AND isfinite(gx) AND isfinite(gy)"
        out += f",it{i + 1} AS (SELECT {_C}, CASE WHEN {ok} THEN x-gx ELSE px END AS px, CASE WHEN {ok} THEN y-gy ELSE py END AS py, {ok} AS valid FROM its{i})"
    return out + f""",m AS (SELECT l.clip_id, l.frame_no, l.y, l.x, CASE WHEN i.valid THEN i.px-i.x ELSE 0e0 END AS vx, CASE WHEN i.valid THEN i.py-i.y ELSE 0e0 END AS vy,
  coalesce(i.valid,false) AS ok FROM wlum l LEFT JOIN it4 i ON {on('i', 'l', _K4)}),"""


@query("e06_import_external_motion_forward", with_fixtures("wpx") + "," + WLUMA_CTE + "," + _FILES + "," + _forward_sql() + _EXT_TAIL)
def import_external_motion_forward(spark, d):
    return _ext(spark, d, "previous_to_current")


def coarse_flow(spark, d):
    f = L.resample_nearest(fx.wide_flow(spark, d), 48, 32, 24, 16)
    return f.select(*CELL, (F.col("vx") * 0.5).alias("vx"), (F.col("vy") * 0.5).alias("vy"),
                    F.least(F.lit(1.0), F.col("confidence") + 0.125).alias("confidence"), "uncertainty")


def _fuse_sql(mode: str) -> str:
    k = M.FUSE[mode]
    strong = " AND cc<fc+.06e0" if mode == "strong" else ""
    return with_fixtures("wflow") + f""",
co AS (SELECT f.clip_id, f.frame_no, ty.y, tx.x, f.vx*.5e0 AS vx, f.vy*.5e0 AS vy, least(1e0, f.confidence+.125e0) AS confidence, f.uncertainty FROM wflow f
  JOIN range(16) ty(y) ON f.y=ty.y*2 JOIN range(24) tx(x) ON f.x=tx.x*2),""" + bilinear(
        "u", f"(SELECT {_C}, vx, vy, confidence, uncertainty FROM wflow)", "co", {"vx": "bx", "vy": "by_", "confidence": "cc0", "uncertainty": "cu0"},
        "(x+.5e0)/2e0-.5e0", "(y+.5e0)/2e0-.5e0", 24, 16) + f""",
a AS (SELECT *, bx*2 AS cx, by_*2 AS cy, {cl('cc0')} AS cc, {cl('cu0')} AS cu, {cl('confidence')} AS fc, {cl('uncertainty')} AS fu FROM u),
b AS (SELECT *, sqrt((vx-cx)*(vx-cx)+(vy-cy)*(vy-cy)) AS res, {k['base']}e0+{k['slope']}e0*sqrt(cx*cx+cy*cy) AS thr, cc>={k['coarse_min']}e0 AS onn FROM a),
c AS (SELECT *, onn AND res<=thr AS agree, {cl('(res-thr)/greatest(1e0,thr*2)')} AS sev, fc>={k['protect']}e0 AND fu<{k['protect_unc']}e0{strong} AS kept FROM b),
e AS (SELECT *, CASE WHEN onn AND NOT agree AND NOT kept THEN {k['blend']}e0*(.25e0+.75e0*sev)*(.55e0+.45e0*cc)*(.72e0+.28e0*fu)*CASE WHEN fc>.75e0 THEN {k['damp']}e0 ELSE 1e0 END ELSE 0e0 END AS bl FROM c)
SELECT {_C}, round(CASE WHEN bl>=.03e0 THEN vx+(cx-vx)*bl ELSE vx END,6)+0e0 AS vx, round(CASE WHEN bl>=.03e0 THEN vy+(cy-vy)*bl ELSE vy END,6)+0e0 AS vy,
 round(CASE WHEN agree THEN greatest(confidence,least(.94e0,.65e0*fc+.35e0*cc)) WHEN bl>=.03e0 THEN greatest(fc,least(.9e0,.58e0*fc+.42e0*cc)) ELSE confidence END,12) AS confidence,
 round(CASE WHEN agree THEN {cl('(.62e0*uncertainty+.38e0*cu)*(1-.28e0*least(greatest(1-res/greatest(.5e0,thr),0e0),1e0))')}
  WHEN bl>=.03e0 THEN {cl('.46e0*fu+.29e0*cu+.25e0*sev')} ELSE uncertainty END,12) AS uncertainty, bl>=.03e0 AS corrected FROM e"""


def _fused(spark, d, mode):
    f = fx.wide_flow(spark, d).select(*CELL, "vx", "vy", "confidence", "uncertainty")
    return M.fuse_coarse(f, coarse_flow(spark, d), 48, 32, 24, 16, mode)


@query("e12_fuse_coarse_auto", _fuse_sql("auto"))
def fuse_auto(spark, d):
    return _fused(spark, d, "auto").select(*CELL, *[r6(F.col(c), n).alias(c) for c, n in (("vx", 6), ("vy", 6), ("confidence", 12), ("uncertainty", 12))], "corrected")


@query("e12_fuse_coarse_strong", _fuse_sql("strong"))
def fuse_strong(spark, d):
    return _fused(spark, d, "strong").select(*CELL, *[r6(F.col(c), n).alias(c) for c, n in (("vx", 6), ("vy", 6), ("confidence", 12), ("uncertainty", 12))], "corrected")
