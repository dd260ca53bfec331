"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import big, r6
from ..functions import colour as K
from ..functions import names as N
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .registry import query

CELL = ["clip_id", "frame_no", "y", "x"]


@query("b01_luma", with_fixtures("px") + """
SELECT clip_id, frame_no, y, x, (2126*r+7152*g+722*b)/10000e0 AS luma,
  CAST(least(round((2126*r+7152*g+722*b)/10000e0),255) AS INT) AS luma8 FROM px""")
def luma(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    return fx.px(spark, d).select(*CELL, K.luma(*rgb).alias("luma"), K.luma8(*rgb).alias("luma8"))


@query("b02_ycocg", with_fixtures("px") + """,
t AS (SELECT clip_id, frame_no, y AS cy, x AS cx, .25e0*r+.5e0*g+.25e0*b AS yy, .5e0*r-.5e0*b AS co, -.25e0*r+.5e0*g-.25e0*b AS cg FROM px)
SELECT clip_id, frame_no, cy AS y, cx AS x, yy, co, cg, yy+co-cg AS r2, yy+cg AS g2, yy-co-cg AS b2 FROM t""")
def ycocg(spark, d):
    p = fx.px(spark, d).withColumn("c", K.rgb_to_ycocg(F.col("r"), F.col("g"), F.col("b")))
    p = p.withColumn("k", K.ycocg_to_rgb(F.col("c.y"), F.col("c.co"), F.col("c.cg")))
    return p.select(*CELL, F.col("c.y").alias("yy"), F.col("c.co").alias("co"), F.col("c.cg").alias("cg"),
                    F.col("k.r").alias("r2"), F.col("k.g").alias("g2"), F.col("k.b").alias("b2"))


@query("b03_tone_map", with_fixtures("tile") + """,
e AS (SELECT vec_id, y, x, greatest(v*4*sqrt(2e0),0e0) AS v FROM tile),
t AS (SELECT vec_id, y, x, least(v,1e0) AS c, v/(1+v) AS h, least(greatest((v*(2.51e0*v+.03e0))/(v*(2.43e0*v+.59e0)+.14e0),0e0),1e0) AS a FROM e)
SELECT vec_id, y, x, CAST(round(c*255e0) AS INT) AS clamped, CAST(round(h*255e0) AS INT) AS reinhard,
 CAST(round((CASE WHEN a<=.0031308e0 THEN 12.92e0*a ELSE 1.055e0*pow(a,1e0/2.4e0)-.055e0 END)*255e0) AS INT) AS aces FROM t""")
def tone_map(spark, d):
    v = F.col("v")
    return fx.tile(spark, d).select("vec_id", "y", "x", K.tone_map(v, 2.5, "clamp", False).alias("clamped"),
                                    K.tone_map(v, 2.5, "reinhard", False).alias("reinhard"),
                                    K.tone_map(v, 2.5, "aces", True).alias("aces"))


@query("b04_select_channel", with_fixtures("px") + """
SELECT clip_id, frame_no, y, x, r/255e0 AS cr, g/255e0 AS cg, b/255e0 AS cb, 1e0 AS ca,
  round((r*.2126e0+g*.7152e0+b*.0722e0)/255e0,6) AS cl FROM px""")
def select_channel(spark, d):
    ch = [F.col(c) / F.lit(255.0) for c in "rgb"] + [F.lit(1.0)]
    return fx.px(spark, d).select(*CELL, *[K.select_channel(*ch, c).alias(f"c{c}") for c in "rgba"],
                                  r6(K.select_channel(F.col("r"), F.col("g"), F.col("b"), F.lit(1.0), "luminance") / 255.0).alias("cl"))


@query("b05_affine_clamp", with_fixtures("tile") + """
SELECT vec_id, y, x, round(least(greatest(v*3e0+.25e0,0e0),1e0),6) AS v FROM tile""")
def affine_clamp(spark, d):
    return fx.tile(spark, d).select("vec_id", "y", "x", r6(K.affine_clamp(F.col("v"), 3.0, 0.25)).alias("v"))


_NAN = "CASE WHEN channel='G' AND y=x THEN 'nan'::DOUBLE WHEN channel='B' AND y=x THEN 'inf'::DOUBLE ELSE value END"


def _broken_chan(spark, d):
    at = F.col("y") == F.col("x")
    return fx.chan(spark, d).withColumn("value", F.when((F.col("channel") == "G") & at, float("nan")).when(
        (F.col("channel") == "B") & at, float("inf")).otherwise(F.col("value")))


@query("b06_map_depth", with_fixtures("chan") + f""",
c AS (SELECT seq_id, frame_no, channel, y, x, {_NAN} AS v FROM chan),
t AS (SELECT *, isfinite(v) AS ok FROM c)
SELECT seq_id, frame_no, channel, y, x, CASE WHEN ok THEN least(greatest(v,0e0),1e0) ELSE 0e0 END AS raw01,
  round(CASE WHEN ok THEN least(greatest((v-100e0)/80e0,0e0),1e0) ELSE 1e0 END,6) AS ranged,
  round(1e0-CASE WHEN ok THEN least(greatest((v-100e0)/80e0,0e0),1e0) ELSE 1e0 END,6) AS inverted FROM t""")
def map_depth(spark, d):
    v = F.col("value")
    return _broken_chan(spark, d).select(
        "seq_id", "frame_no", "channel", "y", "x", K.map_depth(v, "raw01").alias("raw01"),
        r6(K.map_depth(v, "fixed_range", 100.0, 180.0)).alias("ranged"),
        r6(K.map_depth(v, "fixed_range", 100.0, 180.0, True)).alias("inverted"))


@query("b07_import_motion", with_fixtures("chan") + f""",
c AS (SELECT seq_id, frame_no, channel, y AS cy, x AS cx, {_NAN} AS v FROM chan)
SELECT seq_id, frame_no, channel, cy AS y, cx AS x, CASE WHEN isfinite(v) THEN -2e0*v ELSE 0e0 END + 0e0 AS vx,
  CASE WHEN isfinite(v) THEN .5e0*cx ELSE 0e0 END AS vy, isfinite(v) AS valid FROM c""")
def import_motion(spark, d):
    m = K.import_motion(F.col("value"), F.col("x").cast("double"), 2.0, 0.5, flip_x=True)
    c = _broken_chan(spark, d).withColumn("m", m)
    return c.select("seq_id", "frame_no", "channel", "y", "x", (F.col("m.vx") + 0.0).alias("vx"), "m.vy", "m.valid")


@query("b08_decode_fixed", with_fixtures("grid") + """
SELECT clip_id, frame_no, gy, gx, fx/32e0 AS vx, bx/32e0 AS ux, round(cost_f/255e0,6) AS cost FROM grid""")
def decode_fixed(spark, d):
    return fx.grid(spark, d).select("clip_id", "frame_no", "gy", "gx", K.decode_fixed(F.col("fx")).alias("vx"),
                                    K.decode_fixed(F.col("bx")).alias("ux"), r6(K.cost01(F.col("cost_f"))).alias("cost"))


# hue/value to r, g, b over a relation with columns vx, vy and display scale s
def hsv_sql(src: str, keep: str) -> str:
    return f"""hsv0 AS (SELECT {keep}, sqrt(least(greatest(sqrt(vx*vx+vy*vy)/s,0e0),1e0)) AS v,
  (atan2(vy,vx)+pi())/(2e0*pi()) AS h FROM {src}),
hsv1 AS (SELECT {keep}, v, (h-floor(h))*6e0 AS hh FROM hsv0),
hsv2 AS (SELECT {keep}, v, CAST(floor(hh) AS BIGINT) % 6 AS sec, v*(hh-floor(hh)) AS up, v*(1-(hh-floor(hh))) AS dn FROM hsv1),
hsv3 AS (SELECT {keep}, v,
  CASE sec WHEN 0 THEN v WHEN 1 THEN dn WHEN 2 THEN 0e0 WHEN 3 THEN 0e0 WHEN 4 THEN up ELSE v END AS rr,
  CASE sec WHEN 0 THEN up WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN dn WHEN 4 THEN 0e0 ELSE 0e0 END AS gg,
  CASE sec WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN up WHEN 3 THEN v WHEN 4 THEN v ELSE dn END AS bb FROM hsv2),
hsv AS (SELECT {keep}, CASE WHEN v>.005e0 THEN CAST(round(least(greatest(rr,0e0),1e0)*255e0) AS INT) ELSE 0 END AS r,
  CASE WHEN v>.005e0 THEN CAST(round(least(greatest(gg,0e0),1e0)*255e0) AS INT) ELSE 0 END AS g,
  CASE WHEN v>.005e0 THEN CAST(round(least(greatest(bb,0e0),1e0)*255e0) AS INT) ELSE 0 END AS b FROM hsv3)"""


@query("b09_motion_hsv", with_fixtures("track") + ", src AS (SELECT track_id, frame_no, vx, vy, 24e0 AS s FROM track),"
       + hsv_sql("src", "track_id, frame_no") + " SELECT track_id, frame_no, r, g, b FROM hsv")
def motion_hsv(spark, d):
    return fx.track(spark, d).withColumn("c", K.motion_hsv(F.col("vx"), F.col("vy"), F.lit(24.0))).select(
        "track_id", "frame_no", "c.r", "c.g", "c.b")


@query("b10_depth_gray", with_fixtures("chan") + f""",
c AS (SELECT seq_id, frame_no, channel, y, x, {_NAN} AS v FROM chan)
SELECT seq_id, frame_no, channel, y, x, CASE WHEN isfinite(v) THEN CAST(round(least(greatest(v,0e0),1e0)*255e0) AS INT) ELSE 0 END AS gray FROM c""")
def depth_gray(spark, d):
    return _broken_chan(spark, d).select("seq_id", "frame_no", "channel", "y", "x", K.depth_gray(F.col("value")).alias("gray"))


# Sample channel names of the listings below.
CHANNELS = ("ViewLayer.Depth.Z", "Z", "R", "G", "B", "A", "View.Vector.X", "View.Vector.Y", "flow.R", "flow.G",
            "motion.x", "motion.y", "alpha", "Depth.V", "beauty.B", "mist.Depth")


def listings(spark, d):
    """Five named channels per embedding row, in listing order."""
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq_id"), "label",
                                                F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    pick = (F.col("seq_id") * 5 + F.col("label") + F.col("i") * (3 + 2 * (F.col("seq_id") % 3))) % len(CHANNELS)
    return e.select("seq_id", F.col("i").alias("ordinal"), F.get(F.array(*[F.lit(c) for c in CHANNELS]), pick.cast("int")).alias("channel"))


LISTING_SQL = f"""WITH listing AS (SELECT vec_id AS seq_id, i AS ordinal,
  {list(CHANNELS)}[1 + (vec_id*5 + label + i*(3+2*(vec_id % 3))) % {len(CHANNELS)}] AS channel FROM embeddings, range(5) t(i)),
lf AS (SELECT *, lower(channel) AS lc, regexp_extract(lower(channel), '([^.]*)$', 1) AS leaf FROM listing)"""
_MOTION = "(contains(lc,'vector') OR contains(lc,'flow') OR contains(lc,'motion'))"


@query("b11_depth_name_prior", LISTING_SQL + f"""
SELECT seq_id, ordinal, channel, round(CASE WHEN contains(lc,'depth') THEN 5e0 ELSE 0 END + CASE WHEN leaf='z' THEN 5e0 ELSE 0 END
 + CASE leaf WHEN 'r' THEN 1.8e0 WHEN 'g' THEN 1.4e0 WHEN 'b' THEN 1e0 ELSE 0 END
 - CASE WHEN leaf IN ('a','alpha') THEN 8e0 ELSE 0 END - CASE WHEN {_MOTION} THEN 4e0 ELSE 0 END,6) AS prior FROM lf""")
def depth_name_prior(spark, d):
    return listings(spark, d).select("seq_id", "ordinal", "channel", r6(N.depth_name_prior(F.col("channel"))).alias("prior"))


@query("b12_motion_name_prior", LISTING_SQL + f"""
SELECT seq_id, ordinal, channel,
 CASE WHEN {_MOTION} THEN 20 ELSE 0 END + CASE WHEN leaf IN ('x','r') THEN 10 ELSE 0 END - CASE WHEN leaf IN ('a','alpha') THEN 8 ELSE 0 END AS px,
 CASE WHEN {_MOTION} THEN 20 ELSE 0 END + CASE WHEN leaf IN ('y','g') THEN 10 ELSE 0 END - CASE WHEN leaf IN ('a','alpha') THEN 8 ELSE 0 END AS py FROM lf""")
def motion_name_prior(spark, d):
    c = F.col("channel")
    return listings(spark, d).select("seq_id", "ordinal", "channel", N.motion_name_prior(c, "x").alias("px"),
                                     N.motion_name_prior(c, "y").alias("py"))


def _axis_sql(c: str, good: str, swapped: str) -> str:
    return f"""(CASE WHEN {c}.leaf IN {good} THEN 0e0 WHEN {c}.leaf IN {swapped} THEN .02e0 WHEN {c}.leaf IN ('z','b') THEN .035e0
 WHEN {c}.leaf IN ('w','a','alpha') THEN .07e0 ELSE .025e0 END * CASE WHEN {_MOTION.replace('lc', c + '.lc')} THEN .35e0 ELSE 1e0 END)"""


@query("b13_convention_penalty", LISTING_SQL + f"""
SELECT a.seq_id, a.ordinal AS xo, b.ordinal AS yo, round({_axis_sql('a', "('x','r')", "('y','g')")} + {_axis_sql('b', "('y','g')", "('x','r')")}
 + CASE WHEN a.ordinal % 2 = 0 THEN .002e0 ELSE 0 END + CASE WHEN b.ordinal % 2 = 0 THEN .006e0 ELSE 0 END
 + CASE WHEN a.ordinal > 2 THEN .0002e0 ELSE 0 END + CASE WHEN b.ordinal > 2 THEN .0002e0 ELSE 0 END,6) AS penalty
FROM lf a JOIN lf b ON a.seq_id=b.seq_id AND b.ordinal = (a.ordinal + 1) % 5""")
def convention_penalty(spark, d):
    a = listings(spark, d)
    # The next channel of the listing, cyclically, as the y axis.
    b = a.select("seq_id", F.col("ordinal").alias("yo"), F.col("channel").alias("yc"))
    j = a.withColumn("yo", (F.col("ordinal") + 1) % 5).join(b, ["seq_id", "yo"])
    p = N.convention_penalty(F.col("channel"), F.col("yc"), F.when(F.col("ordinal") % 2 == 0, "UV").otherwise("pixels"),
                             F.col("yo") % 2 == 0, F.col("ordinal") > 2, F.col("yo") > 2)
    return j.select("seq_id", F.col("ordinal").alias("xo"), "yo", r6(p).alias("penalty"))


_RULES = {
    "depth": ["lc LIKE '%.depth.z'", "lc LIKE '%.z' AND contains(lc,'depth')", "contains(lc,'depth')", "channel='Z' OR lc LIKE '%.z'",
              "channel='R' OR lc LIKE '%.r'", "channel='G' OR lc LIKE '%.g'", "channel='B' OR lc LIKE '%.b'",
              "NOT (channel='A' OR lc LIKE '%.a')", "true"],
    "motion_x": ["lc LIKE '%.vector.x'", "contains(lc,'vector') AND lc LIKE '%.x'", _MOTION + " AND lc LIKE '%.r'",
                 "channel='X' OR lc LIKE '%.x'", "channel='R' OR lc LIKE '%.r'"],
    "motion_y": ["lc LIKE '%.vector.y'", "contains(lc,'vector') AND lc LIKE '%.y'", _MOTION + " AND lc LIKE '%.g'",
                 "channel='Y' OR lc LIKE '%.y'", "channel='G' OR lc LIKE '%.g'"],
}


def _select_sql() -> str:
    parts = []
    for role, rules in _RULES.items():
        rank = "CASE " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(rules, 1)) + " END"
        parts.append(f"SELECT seq_id, '{role}' AS role, arg_min(channel, rk*100+ordinal) AS channel, min(rk) AS rule FROM "
                     f"(SELECT *, {rank} AS rk FROM lf) WHERE rk IS NOT NULL GROUP BY seq_id")
    return LISTING_SQL + "\n" + "\nUNION ALL\n".join(parts)


@query("b14_auto_select_channel", _select_sql())
def auto_select_channel(spark, d):
    from ..sources.catalog import auto_select_channel as pick

    src = listings(spark, d)
    out = None
    for role in _RULES:
        one = pick(src, role).select("seq_id", F.lit(role).alias("role"), "channel", "rule")
        out = one if out is None else out.unionByName(one)
    return out


@query("b15_softmax_scale_uncertainty", """
WITH q AS (SELECT vec_id, i, CAST(embedding[4*i+1] AS DOUBLE)*4 AS w0, CAST(embedding[4*i+2] AS DOUBLE)*4 AS w1,
  CAST(embedding[4*i+3] AS DOUBLE)*16 AS s0, CAST(embedding[4*i+4] AS DOUBLE)*16 AS s1 FROM embeddings, range(16) t(i)),
e AS (SELECT vec_id, i, (least(greatest(s0,0e0),10e0)*exp(w0-greatest(w0,w1)) + least(greatest(s1,0e0),0e0)*exp(w1-greatest(w0,w1)))
  /(exp(w0-greatest(w0,w1))+exp(w1-greatest(w0,w1))) AS ex FROM q)
SELECT vec_id, i, CAST(floor(least(greatest((1-exp(-(greatest(ex,0e0)/4.5e0)*1.25e0))*255e0,0e0),255e0)) AS INT) AS u8 FROM e""")
def softmax_scale_uncertainty(spark, d):
    e = fx.tile_planes(spark, d).select("vec_id", "plane", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    at = lambda k, s: F.get("plane", 4 * F.col("i") + k) * s
    info = F.array(at(0, 4.0), at(1, 4.0), at(2, 16.0), at(3, 16.0))
    return e.select("vec_id", "i", K.softmax_scale_uncertainty(info, 0.0, 10.0, 1.25).alias("u8"))


@query("b16_uncertainty_to_reliability", with_fixtures("flow") + """,
t AS (SELECT *, x+vx<0 OR y+vy<0 OR x+vx>7 OR y+vy>7 AS outside FROM flow)
SELECT clip_id, frame_no, y, x, round(CASE WHEN outside THEN least(least(greatest((1-.88e0*uncertainty)*1.2e0,.04e0),1e0),.05e0)
  ELSE least(greatest((1-.88e0*uncertainty)*1.2e0,.04e0),1e0) END,6) AS confidence,
  round(CASE WHEN outside THEN 0e0 ELSE 1-.82e0*uncertainty END,6) AS visibility, CASE WHEN outside THEN 1e0 ELSE 0e0 END AS disocclusion FROM t""")
def uncertainty_to_reliability(spark, d):
    f = fx.flow(spark, d).withColumn("k", K.uncertainty_to_reliability(
        F.col("uncertainty"), 1.2, F.col("vx"), F.col("vy"), F.col("x"), F.col("y"), 8, 8))
    return f.select(*CELL, r6(F.col("k.confidence")).alias("confidence"), r6(F.col("k.visibility")).alias("visibility"),
                    F.col("k.disocclusion").alias("disocclusion"))
