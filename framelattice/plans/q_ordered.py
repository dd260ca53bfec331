"""Queries over ordered per-scene filters and their history-free forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import big, r6
from ..operators import consensus as C
from ..operators import scans as S
from ..operators.pairs import scene_segments
from ..sources import fixtures as fx
from ..sources.fields import planes_to_long
from ..sources.fixtures import with_fixtures
from .q_pairs import CUT, GRAY_CTE, WGRAY_CTE, cut_sql, scores
from .registry import query
from .sqltext import bilinear, cl, filled, nine_join, on, previous

CELL = ["clip_id", "frame_no", "y", "x"]
_C = "clip_id, frame_no, y, x"
_K4 = ("clip_id", "frame_no", "y", "x")


def segments(spark, d, wide=False):
    return scene_segments(scores(spark, d, wide=wide), CUT)


# --- depth -------------------------------------------------------------------------------------

_DIN = f"din AS (SELECT w.clip_id, w.frame_no, w.y, w.x, w.vx, w.vy, w.confidence, d.d FROM wflow w JOIN wdepth d ON {on('d', 'w', _K4)})"


def _depth_rule(src: str, cut: str) -> str:
    return f"""CASE WHEN {cut} OR confidence<.25e0 OR abs(d-coalesce(pd,d))>.08e0 THEN d ELSE d*(1-.2e0*confidence)+coalesce(pd,d)*(.2e0*confidence) END"""


@query("f01_stabilize_depth_raw", with_fixtures("wflow", "wdepth") + "," + _DIN + "," + previous("pd0", "wdepth") + ","
       + bilinear("w", "din", "pd0", {"d": "pd"}, "x+vx", "y+vy", 48, 32, reject=True)
       + f" SELECT {_C}, round({_depth_rule('w', 'false')},6) AS d FROM w")
def stabilize_depth_raw(spark, d):
    return S.stabilize_depth_raw(fx.wide_depth(spark, d), fx.wide_flow(spark, d), 48, 32).withColumn("d", r6(F.col("d")))


def _depth_chain() -> str:
    out = f"o1 AS (SELECT {_C}, d FROM din WHERE frame_no=1)"
    for k in range(2, 7):
        out += "," + bilinear(f"w{k}", f"(SELECT i.*, s.cut FROM din i JOIN segments s ON {on('s', 'i')} WHERE i.frame_no={k})",
                              f"(SELECT clip_id, frame_no+1 AS frame_no, y, x, d AS pd FROM o{k - 1})", {"pd": "pd"}, "x+vx", "y+vy", 48, 32, reject=True)
        out += f",o{k} AS (SELECT {_C}, {_depth_rule('w', 'cut')} AS d FROM w{k})"
    return out


@query("f01_stabilize_depth", with_fixtures("wflow", "wdepth", "wpx") + "," + WGRAY_CTE + "," + cut_sql("gray") + "," + _DIN + "," + _depth_chain()
       + " " + " UNION ALL ".join(f"SELECT {_C}, round(d,6) AS d FROM o{k}" for k in range(1, 7)))
def stabilize_depth(spark, d):
    """Exact recurrence over scenes; the SQL unrolls the six frames."""
    cells = fx.wide_flow(spark, d).select(*CELL, "vx", "vy", "confidence").join(fx.wide_depth(spark, d), CELL)
    planes = S.scene_planes(cells, ["d", "vx", "vy", "confidence"], segments(spark, d, True))
    return planes_to_long(S.stabilize_depth(planes, 48, 32), ["d"], 48).withColumn("d", r6(F.col("d")))


# --- output ------------------------------------------------------------------------------------

_OIN = f"oin AS (SELECT f.clip_id, f.frame_no, f.y, f.x, f.vx, f.vy, f.confidence, p.r, p.g, p.b FROM flow f JOIN px p ON {on('p', 'f', _K4)})"


def _out_rule(cut: str) -> str:
    worst = "greatest(abs(r-coalesce(pr,0)),abs(g-coalesce(pg,0)),abs(b-coalesce(pb,0)))/255e0"
    return ", ".join(f"CASE WHEN {cut} OR confidence<.35e0 OR {worst}>.12e0 THEN CAST({c} AS BIGINT) ELSE CAST(least(greatest(round({c}*(1-.14e0*confidence)+coalesce(p{c},0)*(.14e0*confidence)),0),255) AS BIGINT) END AS {c}" for c in "rgb")


@query("f02_stabilize_output_raw", with_fixtures("flow", "px") + "," + _OIN + "," + previous("pp", "px") + ","
       + bilinear("w", "oin", "pp", {"r": "pr", "g": "pg", "b": "pb"}, "x+vx", "y+vy", 8, 8, reject=True, how="JOIN")
       + f" SELECT {_C}, {_out_rule('frame_no=1')} FROM (" + filled("oin", "w", ["r", "g", "b", "confidence"], ["pr", "pg", "pb"]) + ")")
def stabilize_output_raw(spark, d):
    return S.stabilize_output_raw(fx.px(spark, d), fx.flow(spark, d), 8, 8)


def _out_chain() -> str:
    out = f"o1 AS (SELECT {_C}, r, g, b FROM oin WHERE frame_no=1)"
    for k in range(2, 7):
        out += "," + bilinear(f"w{k}", f"(SELECT i.*, s.cut FROM oin i JOIN segments s ON {on('s', 'i')} WHERE i.frame_no={k})",
                              f"(SELECT clip_id, frame_no+1 AS frame_no, y, x, r AS pr, g AS pg, b AS pb FROM o{k - 1})", {"pr": "pr", "pg": "pg", "pb": "pb"},
                              "x+vx", "y+vy", 8, 8, reject=True)
        out += f",o{k} AS (SELECT {_C}, {_out_rule('cut')} FROM w{k})"
    return out


@query("f02_stabilize_output", with_fixtures("flow", "px") + "," + GRAY_CTE + "," + cut_sql("gray") + "," + _OIN + "," + _out_chain()
       + " " + " UNION ALL ".join(f"SELECT {_C}, r, g, b FROM o{k}" for k in range(1, 7)))
def stabilize_output(spark, d):
    planes = S.scene_planes(_pixels_with_flow(spark, d), ["r", "g", "b", "vx", "vy", "confidence"], segments(spark, d))
    out = planes_to_long(S.stabilize_output(planes, 8, 8), ["r", "g", "b"], 8)
    return out.select(*CELL, *[big(c).alias(c) for c in "rgb"])


# --- denoiser ----------------------------------------------------------------------------------


def _pixels_with_flow(spark, d):
    return fx.px(spark, d).join(fx.flow(spark, d).select(*CELL, "vx", "vy", "confidence"), CELL)


_SW = "(CASE abs(o.dy)+abs(o.dx) WHEN 0 THEN 1e0 WHEN 1 THEN .72e0 ELSE .52e0 END * exp(-abs(n.l-c.l)/.0792e0))"


def denoise_sql() -> str:
    """CTEs o1..o6: the six frames of the recursive filter, unrolled."""
    k = S.Denoise()
    q = "(.25e0*{r}+.5e0*{g}+.25e0*{b})", "(.5e0*{r}-.5e0*{b})", "(-.25e0*{r}+.5e0*{g}-.25e0*{b})"
    cur, old = ([e.format(**{c: v.format(c=c) for c in "rgb"}) for e in q] for v in ("({c}/255e0)", "(h{c}/255e0)"))
    out = f"""ycc AS (SELECT p.clip_id, p.frame_no, p.y, p.x, p.r, p.g, p.b, {cur[0]} AS l, {cur[1]} AS co, {cur[2]} AS cg FROM px p),
""" + nine_join("nb", "ycc", ", ".join(f"min(n.{v}) AS lo_{v}, max(n.{v}) AS hi_{v}" for v in ("l", "co", "cg"))
                + ", avg(n.l) AS m, avg(n.l*n.l) AS m2, " + ", ".join(f"sum(n.{c}*{_SW})/sum({_SW})/255e0 AS s{c}" for c in "rgb"), 8, 8) + f""",
st0 AS (SELECT nb.*, y1.r, y1.g, y1.b, y1.l, y1.co, y1.cg, f.vx, f.vy, f.confidence, s.cut, sqrt(greatest(0e0,m2-m*m)) AS sigma, {cl('(hi_l-lo_l-.025e0)/.16e0')} AS t
  FROM nb JOIN ycc y1 ON {on('y1', 'nb', _K4)} JOIN flow f ON {on('f', 'nb', _K4)} JOIN segments s ON {on('s', 'nb')}),
st1 AS (SELECT *, t*t*(3-2*t) AS edge FROM st0), st2 AS (SELECT *, {k.spatial}e0*{k.strength}e0*(1-edge*{k.detail}e0) AS ap FROM st1),
st AS (SELECT *, {', '.join(f'{c}/255e0+(s{c}-{c}/255e0)*ap AS b{c}' for c in 'rgb')} FROM st2),
o1 AS (SELECT {_C}, {', '.join(f'CAST(round({cl(f"b{c}")}*255e0) AS BIGINT) AS {c}' for c in 'rgb')}, 1 AS age FROM st WHERE frame_no=1)"""
    for i in range(2, 7):
        out += "," + bilinear(f"w{i}", f"(SELECT * FROM st WHERE frame_no={i})", f"(SELECT clip_id, frame_no+1 AS frame_no, y, x, r AS hr, g AS hg, b AS hb FROM o{i - 1})",
                              {"hr": "hr", "hg": "hg", "hb": "hb"}, "x+vx", "y+vy", 8, 8, flag="ins")
        out += f""",
a{i} AS (SELECT w.*, CASE WHEN ins AND NOT cut THEN a.age ELSE 0 END AS pa FROM w{i} w LEFT JOIN o{i - 1} a ON a.clip_id=w.clip_id AND a.frame_no=w.frame_no-1
  AND a.y=CAST(least(7,greatest(0,round(w.y+w.vy))) AS BIGINT) AND a.x=CAST(least(7,greatest(0,round(w.x+w.vx))) AS BIGINT)),
c{i} AS (SELECT *, {cl(old[0], '(lo_l-.025e0-.7e0*sigma)', '(hi_l+.025e0+.7e0*sigma)')} AS hl, {cl(old[1], '(lo_co-.03375e0-.45e0*sigma)', '(hi_co+.03375e0+.45e0*sigma)')} AS ho,
  {cl(old[2], '(lo_cg-.03375e0-.45e0*sigma)', '(hi_cg+.03375e0+.45e0*sigma)')} AS hg2 FROM a{i}),
h{i} AS (SELECT *, CASE WHEN pa>0 AND confidence>=.08e0 THEN {cl(f"{k.history}e0*{k.strength}e0*confidence*exp(-(((hl-l)/.14e0)**2))*exp(-((greatest(abs(ho-co),abs(hg2-cg))/.18e0)**2))*(.72e0+.28e0*exp(-sqrt(vx*vx+vy*vy)/36e0))*least(greatest(pa/6e0,.2e0),1e0)*(1-.36e0*edge*{k.detail}e0)", '0e0', '.965e0')} ELSE 0e0 END AS hw FROM c{i}),
m{i} AS (SELECT *, CASE WHEN hw>.01e0 THEN br+({cl('hl+ho-hg2')}-br)*hw ELSE br END AS mr, CASE WHEN hw>.01e0 THEN bg+({cl('hl+hg2')}-bg)*hw ELSE bg END AS mg,
  CASE WHEN hw>.01e0 THEN bb+({cl('hl-ho-hg2')}-bb)*hw ELSE bb END AS mb FROM h{i}),
o{i} AS (SELECT {_C}, {', '.join(f'CAST(round({cl(f"m{c}+({c}/255e0-m{c})*(ap*hw*.55e0)")}*255e0) AS BIGINT) AS {c}' for c in 'rgb')}, CASE WHEN hw>.01e0 THEN least({k.max_age},pa+1) ELSE 1 END AS age FROM m{i})"""
    return out


@query("f03_temporal_denoise", with_fixtures("px", "flow") + "," + GRAY_CTE + "," + cut_sql("gray") + "," + denoise_sql()
       + " " + " UNION ALL ".join(f"SELECT {_C}, r, g, b, CAST(age AS BIGINT) AS age FROM o{i}" for i in range(1, 7)))
def temporal_denoise(spark, d):
    """Exact recurrence over scenes, computed in double to be compared; the SQL unrolls the six frames."""
    planes = S.scene_planes(_pixels_with_flow(spark, d), ["r", "g", "b", "vx", "vy", "confidence"], segments(spark, d))
    out = planes_to_long(S.temporal_denoise(planes, 8, 8, dtype="double"), ["r", "g", "b", "age"], 8)
    return out.select(*CELL, *[big(c).alias(c) for c in ("r", "g", "b", "age")])


@query("f03_denoise_stats")
def denoise_stats(spark, d):
    """Telemetry of the wide raster's denoiser."""
    cells = fx.wide_px(spark, d).join(fx.wide_flow(spark, d).select(*CELL, "vx", "vy", "confidence"), CELL)
    planes = S.scene_planes(cells, ["r", "g", "b", "vx", "vy", "confidence"], segments(spark, d, True), "float")
    return S.temporal_denoise(planes, 48, 32).select("clip_id", "scene_id", "frame_no", *[r6(F.col(c)).alias(c) for c in S.DENOISE_STATS])


_LUM = f"lum AS (SELECT {_C}, r, g, b, (.25e0*r+.5e0*g+.25e0*b)/255e0 AS l FROM px),"


@query("f03_spatial_denoise", with_fixtures("px") + "," + _LUM + nine_join(
    "s", "lum", ", ".join(f"sum(n.{c}*{_SW})/sum({_SW}) AS s{c}" for c in "rgb") + ", max(n.l)-min(n.l) AS rng", 8, 8)
       + f""", t AS (SELECT s.*, lum.r, lum.g, lum.b, {cl('(rng-.025e0)/.16e0')} AS t FROM s JOIN lum ON {on('lum', 's', _K4)}),
a AS (SELECT *, .22e0*.72e0*(1-t*t*(3-2*t)*.86e0) AS ap FROM t)
SELECT {_C}, """ + ", ".join(f"CAST(round(least(greatest({c}/255e0+(s{c}/255e0-{c}/255e0)*ap,0e0),1e0)*255e0) AS BIGINT) AS {c}" for c in "rgb") + ", round(ap,6) AS spatial_weight FROM a")
def spatial_denoise(spark, d):
    return S.spatial_denoise(fx.px(spark, d)).withColumn("spatial_weight", r6(F.col("spatial_weight")))


@query("f05_history_age", with_fixtures("flow") + f""",
r AS (SELECT {_C}, CASE WHEN confidence>=.5625e0 AND frame_no>1 THEN 0 ELSE 1 END AS z FROM flow),
i AS (SELECT *, sum(z) OVER (PARTITION BY clip_id, y, x ORDER BY frame_no) AS isle FROM r)
SELECT {_C}, least(3, row_number() OVER (PARTITION BY clip_id, y, x, isle ORDER BY frame_no)) AS age FROM i""")
def history_age(spark, d):
    f = fx.flow(spark, d).select(*CELL, (F.col("confidence") >= 0.5625).alias("accept"))
    return S.history_age(f, "accept", 3).select(*CELL, "age")


# --- trajectory consensus ----------------------------------------------------------------------


@query("f04_trajectory_consensus")
def trajectory_consensus(spark, d):
    fields = ["vx", "vy", "confidence", "visibility", "uncertainty", "disocclusion"]
    planes = S.scene_planes(fx.wide_flow(spark, d).select(*CELL, *fields), fields, segments(spark, d, True))
    out = S.trajectory_consensus(planes, 48, 32, "strong", 4)
    return planes_to_long(out, ["vx", "vy", "confidence", "uncertainty"], 48).select(
        *CELL, *[r6(F.col(c)).alias(c) for c in ("vx", "vy", "confidence", "uncertainty")])


def consensus_sql() -> str:
    """CTEs o1..o6: the careful mode over the wide raster, whose history is one lattice of step 4."""
    k = C.RULES["auto"]
    cols = ("vx", "vy", "confidence", "visibility", "uncertainty", "disocclusion")
    out = f"""cin AS (SELECT w.clip_id, w.frame_no, w.y, w.x, {', '.join(f'w.{c}' for c in cols)}, s.cut FROM wflow w JOIN segments s ON {on('s', 'w')}),
o1 AS (SELECT * FROM cin WHERE frame_no=1)"""
    lat = lambda src: f"(SELECT * EXCLUDE (y, x), CAST(y//4 AS BIGINT) AS y, CAST(x//4 AS BIGINT) AS x FROM {src} WHERE y%4=2 AND x%4=2 AND NOT cut)"
    for i in range(2, 7):
        hist = f"(SELECT clip_id, frame_no+1 AS frame_no, y, x, vx AS hx, vy AS hy, confidence AS hc, visibility AS hv, uncertainty AS hu FROM {lat(f'o{i - 1}')})"
        out += "," + bilinear(f"s{i}", lat(f"(SELECT * FROM cin WHERE frame_no={i})"), hist, {c: c for c in ("hx", "hy", "hc", "hv", "hu")},
                              "((x+.5e0)*4-.5e0+vx+.5e0)/4-.5e0", "((y+.5e0)*4-.5e0+vy+.5e0)/4-.5e0", 12, 8, reject=True)
        out += f""",
t{i} AS (SELECT *, hc*hv*(1-.7e0*hu) AS rel, sqrt((vx-hx)**2+(vy-hy)**2) AS res, ({k['base']}e0+{k['slope']}e0*sqrt(hx*hx+hy*hy))*{cl('1.1e0+.55e0*hu-.38e0*uncertainty', '.72e0', '1.55e0')} AS thr FROM s{i}
  WHERE hc>={k['conf']}e0 AND hv>={k['min_vis']}e0 AND hu<={k['max_unc']}e0 AND visibility>=.18e0 AND disocclusion<=.72e0),
b{i} AS (SELECT *, {k['blend']}e0*(.3e0+.7e0*{cl('(res-thr)/greatest(.75e0,thr*1.6e0)')})*(.45e0+.55e0*rel)*(.58e0+.42e0*visibility)*(.62e0+.38e0*uncertainty)*(1-.42e0*hu)
  *CASE WHEN confidence>={k['protect']}e0 AND uncertainty<.36e0 THEN {k['protect_scale']}e0 ELSE 1e0 END AS bl FROM t{i}
  WHERE res>thr AND ((confidence<.7e0 AND hc>=.68e0) OR (res>thr*{k['slip']}e0 AND hc>=.8e0 AND (confidence<.92e0 OR uncertainty>.45e0)))),
d{i} AS (SELECT l.clip_id, l.frame_no, l.y, l.x, coalesce((b.hx-b.vx)*b.bl,0e0) AS dx, coalesce((b.hy-b.vy)*b.bl,0e0) AS dy, coalesce(b.bl,0e0) AS wt
  FROM {lat(f'(SELECT * FROM cin WHERE frame_no={i})')} l LEFT JOIN b{i} b ON {on('b', 'l', _K4)} AND b.bl>=.04e0)"""
        out += "," + bilinear(f"w{i}", f"(SELECT * FROM cin WHERE frame_no={i})", f"d{i}", {"dx": "dx", "dy": "dy", "wt": "wt"},
                              "(x+.5e0)/4-.5e0", "(y+.5e0)/4-.5e0", 12, 8, reject=True)
        out += f""",o{i} AS (SELECT {_C}, CASE WHEN wt>.001e0 THEN vx+dx ELSE vx END AS vx, CASE WHEN wt>.001e0 THEN vy+dy ELSE vy END AS vy,
  CASE WHEN wt>.001e0 THEN greatest(confidence,least(.92e0,.72e0+.2e0*wt)) ELSE confidence END AS confidence, visibility,
  CASE WHEN wt>.001e0 THEN greatest(.1e0,uncertainty*(1-.28e0*wt)) ELSE uncertainty END AS uncertainty, disocclusion, cut FROM w{i})"""
    return out


@query("f04_trajectory_consensus_auto", with_fixtures("wflow", "wpx") + "," + WGRAY_CTE + "," + cut_sql("gray") + "," + consensus_sql() + " "
       + " UNION ALL ".join(f"SELECT {_C}, round(vx,6)+0e0 AS vx, round(vy,6)+0e0 AS vy, round(confidence,12) AS confidence, round(uncertainty,12) AS uncertainty FROM o{i}"
                            for i in range(1, 7)))
def trajectory_consensus_auto(spark, d):
    """The recurrence with one lattice of history; the SQL unrolls the six frames."""
    fields = ["vx", "vy", "confidence", "visibility", "uncertainty", "disocclusion"]
    planes = S.scene_planes(fx.wide_flow(spark, d).select(*CELL, *fields), fields, segments(spark, d, True))
    out = planes_to_long(S.trajectory_consensus(planes, 48, 32, "auto", 4), ["vx", "vy", "confidence", "uncertainty"], 48)
    return out.select(*CELL, *[r6(F.col(c), n).alias(c) for c, n in (("vx", 6), ("vy", 6), ("confidence", 12), ("uncertainty", 12))])


@query("f04_consensus_diagnostics")
def consensus_diagnostics(spark, d):
    fields = ["vx", "vy", "confidence", "visibility", "uncertainty", "disocclusion"]
    planes = S.scene_planes(fx.wide_flow(spark, d).select(*CELL, *fields), fields, segments(spark, d, True))
    out = S.trajectory_consensus(planes, 48, 32, "auto", 4)
    return out.select("clip_id", "scene_id", "frame_no", r6(F.col("corrected_fraction")).alias("corrected_fraction"),
                      r6(F.col("mean_residual")).alias("mean_residual"), F.col("history").cast("bigint").alias("history"))


def tracks_sql(mode: str) -> str:
    k = C.RULES[mode]
    n = k["depth"]
    lags = ", ".join(f"lag(f,{i}) OVER w AS f{i}, lag(vx,{i}) OVER w AS x{i}, lag(vy,{i}) OVER w AS y{i}, lag(confidence,{i}) OVER w AS c{i}" for i in range(1, n + 1))
    ok = lambda i: f"(f{i}>=2 AND c{i}>={k['conf']}e0 AND 1-c{i}<={k['max_unc']}e0)"
    cnt = "CASE " + " ".join(f"WHEN NOT coalesce({ok(i)},false) THEN {i - 1}" for i in range(1, n + 1)) + f" ELSE {n} END"

    def med(v):  # v(i): value of entry i
        if n == 1:
            return f"CASE WHEN cnt>=1 THEN {v(1)} END"
        m3 = f"({v(1)}+{v(2)}+{v(3)}-greatest({v(1)},{v(2)},{v(3)})-least({v(1)},{v(2)},{v(3)}))"
        mid = f"CASE WHEN ({v(1)}>={v(2)} AND {v(1)}<={v(3)}) OR ({v(1)}<={v(2)} AND {v(1)}>={v(3)}) THEN {v(1)} WHEN ({v(2)}>={v(1)} AND {v(2)}<={v(3)}) OR ({v(2)}<={v(1)} AND {v(2)}>={v(3)}) THEN {v(2)} ELSE {v(3)} END"
        del m3
        return f"CASE cnt WHEN 0 THEN NULL WHEN 1 THEN {v(1)} WHEN 2 THEN .5e0*({v(1)}+{v(2)}) ELSE {mid} END"

    def mean(v):
        return "(" + "+".join(f"CASE WHEN cnt>={i} THEN {v(i)} ELSE 0e0 END" for i in range(1, n + 1)) + ")/greatest(cnt,1)"

    sql = with_fixtures("track") + f""",
t0 AS (SELECT track_id, frame_no, frame_no AS f, vx, vy, confidence FROM track),
l AS (SELECT *, {lags} FROM t0 WINDOW w AS (PARTITION BY track_id ORDER BY frame_no)),
c AS (SELECT *, {cnt} AS cnt FROM l),
m AS (SELECT *, {med(lambda i: f'x{i}')} AS ex0, {med(lambda i: f'y{i}')} AS ey0, {mean(lambda i: f'c{i}')} AS hc, {mean(lambda i: f'(1-c{i})')} AS hu,
  {mean(lambda i: f'c{i}*1e0*(1-.7e0*(1-c{i}))')} AS rel FROM c),
s AS (SELECT *, {med(lambda i: f'sqrt((x{i}-ex0)*(x{i}-ex0)+(y{i}-ey0)*(y{i}-ey0))')} AS spread FROM m),"""
    if n >= 3:
        sql += f"""
p AS (SELECT *, (CASE WHEN cnt>=3 THEN {k['tri_base']}e0+{k['tri_gain']}e0*{cl('1-sqrt(((x1-x2)-(x2-x3))**2+((y1-y2)-(y2-y3))**2)/greatest(.65e0,.7e0+.24e0*greatest(sqrt((x1-x2)**2+(y1-y2)**2),sqrt((x2-x3)**2+(y2-y3)**2)))')}
  WHEN cnt=2 THEN {k['pair_weight']}e0 ELSE 0e0 END)*{cl('rel')} AS pw FROM s),
e AS (SELECT *, CASE WHEN cnt>=2 THEN ex0+(x1+(x1-x2)-ex0)*pw ELSE ex0 END AS ex, CASE WHEN cnt>=2 THEN ey0+(y1+(y1-y2)-ey0)*pw ELSE ey0 END AS ey FROM p),"""
    else:
        sql += " e AS (SELECT *, ex0 AS ex, ey0 AS ey FROM s),"
    fix = (f"res>thr AND hc>={k['conf']}e0" if mode == "strong" else
           f"res>thr AND ((confidence<.7e0 AND hc>=.68e0) OR (res>thr*{k['slip']}e0 AND hc>=.8e0 AND (confidence<.92e0 OR 1-confidence>.45e0)))")
    return sql + f"""
r AS (SELECT *, sqrt(ex*ex+ey*ey) AS em, sqrt((vx-ex)*(vx-ex)+(vy-ey)*(vy-ey)) AS res FROM e),
h AS (SELECT *, ({k['base']}e0+{k['slope']}e0*em+{k['spread']}e0*spread)*{cl('1.1e0+.55e0*hu-.38e0*(1-confidence)', '.72e0', '1.55e0')} AS thr FROM r),
b AS (SELECT *, {k['blend']}e0*(.3e0+.7e0*{cl('(res-thr)/greatest(.75e0,thr*1.6e0)')})*(.45e0+.55e0*rel)*1e0*(.62e0+.38e0*(1-confidence))*(1-.42e0*hu)
  *CASE WHEN confidence>={k['protect']}e0 AND 1-confidence<.36e0 THEN {k['protect_scale']}e0 ELSE 1e0 END AS bl,
  coalesce(cnt>={k['samples']} AND spread<={k['max_spread']}e0+.06e0*em AND {fix}, false) AS fix FROM h)
SELECT track_id, frame_no, cnt AS history, CASE WHEN fix AND bl>=.04e0 THEN round(bl,6) ELSE 0e0 END AS blend,
 round(CASE WHEN fix AND bl>=.04e0 THEN vx+(ex-vx)*bl ELSE vx END,6)+0e0 AS out_vx, round(CASE WHEN fix AND bl>=.04e0 THEN vy+(ey-vy)*bl ELSE vy END,6)+0e0 AS out_vy FROM b"""


def _tracks(spark, d, mode):
    t = C.consensus_tracks(fx.track(spark, d).select("track_id", "frame_no", "vx", "vy", "confidence"), mode)
    return t.select("track_id", "frame_no", big("history").alias("history"), *[r6(F.col(c)).alias(c) for c in ("blend", "out_vx", "out_vy")])


@query("f04_consensus_tracks_auto", tracks_sql("auto"))
def tracks_auto(spark, d):
    return _tracks(spark, d, "auto")


@query("f04_consensus_tracks_strong", tracks_sql("strong"))
def tracks_strong(spark, d):
    return _tracks(spark, d, "strong")
