"""Raster, flow, grid, track, probe and log views derived from the business tables.

Each view has a DataFrame form here and, under the same name, a text form in ``FIXTURE_SQL`` used by
the cross-engine checks. Cells without a source row get n = 0, so every lattice is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import big


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ints(lo: int, hi: int) -> Column:
    return F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))


def _lattice(spark, sf_dir, clip: Column, width: int, height: int) -> DataFrame:
    """Complete (clip, frame 1..6, y, x) lattice with n = summed quantity modulo 8.

    One zero-quantity row a frame travels with the hits and unfolds into all cells behind the exchange, so one aggregation replaces grid +
    left join. The exchange has a fixed number of partitions: adaptive execution would put the few rows a frame into one task, which then
    made and combined every cell.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
    y, x = F.floor(F.col("l_partkey") / F.lit(float(width))) % height, F.col("l_partkey") % width
    if (width, height) == (8, 8):
        y, x = F.col("l_partkey") % 8, F.floor(F.col("l_partkey") / F.lit(8.0)) % 8
    hits = li.select(clip.alias("clip_id"), (F.lit(1) + F.col("l_orderkey") % 6).alias("frame_no"), big(y * width + x).alias("cell"),
                     F.col("l_quantity").alias("q")).where("cell >= 0")
    fill = li.select(clip.alias("clip_id")).distinct().select(
        "clip_id", F.explode(_ints(1, 6)).alias("frame_no"), big(F.lit(-1)).alias("cell"), F.lit(0.0).alias("q"))
    d = hits.unionByName(fill).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip_id", "frame_no")
    cells = F.when(F.col("cell") < 0, _ints(0, width * height - 1)).otherwise(F.array("cell"))
    return (
        d.select("clip_id", "frame_no", F.explode(cells).alias("cell"), "q").groupBy("clip_id", "frame_no", "cell")
        .agg((big(F.sum("q")) % 8).alias("n"))
        .select("clip_id", "frame_no", big(F.floor(F.col("cell") / F.lit(float(width)))).alias("y"), (F.col("cell") % width).alias("x"), "n")
        .withColumn("base", ((F.col("x") + F.col("frame_no")) * 23 + F.col("y") * 11 + F.col("clip_id") * 29) % 200)
    )


def raster(spark, sf_dir) -> DataFrame:
    """8x8 lattice, one clip per supplier."""
    return _lattice(spark, sf_dir, F.col("l_suppkey"), 8, 8)


def wide_raster(spark, sf_dir) -> DataFrame:
    """48x32 lattice, one clip per 25 suppliers."""
    return _lattice(spark, sf_dir, big(F.floor(F.col("l_suppkey") / F.lit(25.0))), 48, 32)


def _pixels(g: DataFrame) -> DataFrame:
    cut = (F.col("clip_id") % 3 == 0) & (F.col("frame_no") >= 4)
    v = F.col("base") + F.col("n")
    return g.select(
        "clip_id", "frame_no", "y", "x",
        F.when(cut, 255 - F.col("base") - F.col("n")).otherwise(v).alias("r"),
        F.when(cut, F.lit(40).cast("bigint")).otherwise(v).alias("g"),
        F.when(cut, F.lit(230).cast("bigint")).otherwise(100 + F.col("n")).alias("b"),
    )


def px(spark, sf_dir) -> DataFrame:
    return _pixels(raster(spark, sf_dir))


def wide_px(spark, sf_dir) -> DataFrame:
    return _pixels(wide_raster(spark, sf_dir))


def flow(spark, sf_dir) -> DataFrame:
    bad = F.col("n") == 7
    k = F.col("clip_id") * 7 + F.col("frame_no") * 5 + F.col("y") * 3 + F.col("x")
    return raster(spark, sf_dir).select(
        "clip_id", "frame_no", "y", "x",
        F.when(bad, -5.0).otherwise(-1.0).alias("vx"), F.when(bad, 2.0).otherwise(0.0).alias("vy"),
        F.when(bad, 0.125).otherwise((32 + k % 32) / F.lit(64.0)).alias("confidence"),
        F.when(F.col("x") + F.when(bad, -5).otherwise(-1) < 0, 0.0).otherwise(1.0).alias("visibility"),
        F.when(bad, 0.875).otherwise(0.125).alias("uncertainty"),
    )


def wide_flow(spark, sf_dir) -> DataFrame:
    """A gentle zoom around the centre with data-driven outliers (n = 7)."""
    bad = F.col("n") == 7
    k = F.col("clip_id") * 7 + F.col("frame_no") * 5 + F.col("y") * 3 + F.col("x")
    return wide_raster(spark, sf_dir).select(
        "clip_id", "frame_no", "y", "x",
        F.when(bad, -4.0).otherwise(F.lit(1.0) + (F.col("x") - 24) / F.lit(64.0)).alias("vx"),
        F.when(bad, 2.0).otherwise((F.col("y") - 16) / F.lit(64.0)).alias("vy"),
        F.when(bad, 0.125).otherwise((40 + k % 24) / F.lit(64.0)).alias("confidence"),
        F.when(F.col("n") == 6, 0.5).otherwise(1.0).alias("visibility"),
        F.when(bad, 0.875).otherwise((4 + k % 16) / F.lit(64.0)).alias("uncertainty"),
        F.when(F.col("n") == 5, 0.5).otherwise(0.0).alias("disocclusion"),
        F.when(F.col("n") == 4, 0.5).otherwise(0.0).alias("occlusion"),
    )


def motion_chan(spark, sf_dir) -> DataFrame:
    """Guidance channels of the wide raster: R holds its true x motion, G its y motion."""
    r = wide_raster(spark, sf_dir)
    n = F.col("n")
    vals = F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("value")) for c, v in (
        ("A", F.lit(1.0)), ("B", n / F.lit(8.0)), ("G", F.lit(0.0)), ("R", F.when(n == 7, 3.0).otherwise(1.0)))])
    return r.select(F.col("clip_id").alias("seq_id"), "frame_no", "y", "x", F.explode(vals).alias("c")).select(
        "seq_id", "frame_no", "c.channel", "y", "x", "c.value")


def wide_depth(spark, sf_dir) -> DataFrame:
    """Near block in front of a sloped background."""
    near = (F.col("x") >= 16) & (F.col("x") < 32) & (F.col("y") >= 8) & (F.col("y") < 24)
    return wide_raster(spark, sf_dir).select(
        "clip_id", "frame_no", "y", "x",
        F.when(near, F.lit(0.25)).otherwise(F.lit(0.5) + F.col("y") / F.lit(256.0)).alias("d"),
    )


def grid(spark, sf_dir) -> DataFrame:
    """4x4 packed motion grid over the 8x8 raster (step 2): every block sums its four cells."""
    g = raster(spark, sf_dir).groupBy(
        "clip_id", "frame_no", big(F.floor(F.col("y") / F.lit(2.0))).alias("gy"),
        big(F.floor(F.col("x") / F.lit(2.0))).alias("gx"),
    ).agg((F.sum("n") % 8).alias("m"))
    return g.select(
        "clip_id", "frame_no", "gy", "gx",
        F.when(F.col("m") == 7, -160).otherwise(-32).alias("fx"), F.lit(0).alias("fy"),
        F.when(F.col("m") == 6, 0).otherwise(32).alias("bx"), F.lit(0).alias("by_"),
        F.when(F.col("m") == 7, 250).otherwise(8).alias("cost_f"), F.lit(8).alias("cost_b"),
    )


def track(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("track_id"), big(F.row_number().over(w)).alias("frame_no"),
        (F.lit(-6.0) + F.when(F.col("event_type") == "error", 4.0).otherwise(0.0)).alias("vx"),
        (F.round("value") / F.lit(8.0)).alias("vy"),
        ((22 + F.col("event_id") % 42) / F.lit(64.0)).alias("confidence"), "ts", "event_type",
    )


def paths(spark, sf_dir) -> DataFrame:
    """Numbered files per track; 'error' events are the frames whose file is missing."""
    return track(spark, sf_dir).where(F.col("event_type") != "error").select(
        "track_id", "frame_no",
        F.concat(F.lit("/render/t"), F.col("track_id").cast("string"), F.lit("/shot_"),
                 F.lpad((1000 + F.col("frame_no")).cast("string"), 4, "0"),
                 F.when(F.col("frame_no") % 11 == 0, ".EXR").otherwise(".exr")).alias("path"),
    )


def stage(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("clip_id"), F.col("event_id").alias("frame_no"),
        (F.round(F.col("value") * 8) / F.lit(8.0)).alias("decode_ms"),
        (F.round(F.col("value") * 3) / F.lit(8.0)).alias("flow_ms"),
        ((F.col("event_id") % 9) / F.lit(4.0)).alias("denoise_ms"), "ts",
    )


def chan(spark, sf_dir) -> DataFrame:
    """Four named channels per embedding row on an 8x8 lattice; R is metric depth."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq_id"), F.col("vec_id").alias("frame_no"))
    cells = e.select(
        "*", F.explode(F.array(*[F.lit(c) for c in "ABGR"])).alias("channel"),
    ).select("*", F.explode(_ints(0, 7)).alias("y")).select(
        "*", F.explode(_ints(0, 7)).alias("x"))
    return cells.withColumn(
        "value",
        F.when(F.col("channel") == "A", 1.0)
        .when(F.col("channel") == "R",
              F.lit(100.0) + 8.0 * F.col("x") + 4.0 * F.col("y") + 2.0 * (F.col("frame_no") % 16))
        .when(F.col("channel") == "G", (F.col("x") + F.col("y")) / F.lit(16.0)).otherwise(0.0),
    )


def tile_planes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("plane"))


def tile(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", big(F.floor(F.col("pos") / F.lit(8.0))).alias("y"), big(F.col("pos") % 8).alias("x"),
        F.col("v").cast("double").alias("v"))


def probe(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    lines = [
        F.concat(F.lit("width="), (320 + 16 * (k % 9)).cast("string")),
        F.concat(F.lit("height="), (180 + 9 * (k % 9)).cast("string")),
        F.when(k % 2 == 0, "avg_frame_rate=30000/1001").otherwise("avg_frame_rate=24/1"),
        F.when(k % 3 == 0, "nb_frames=N/A").otherwise(F.concat(F.lit("nb_frames="), (100 + k).cast("string"))),
        F.concat(F.lit("duration="), (1 + k % 30).cast("string")),
        F.when(k % 5 == 0, "codec_name=[libaom-av1 @ x] Failed").otherwise(
            F.concat(F.lit("codec_name= "), F.col("c_mktsegment"))),
        F.lit("codec_tag_string=av01"),
    ]
    return table(spark, sf_dir, "customer").select(
        k.alias("clip_id"), F.posexplode(F.array(*lines)).alias("pos", "line")).select(
        "clip_id", (F.col("pos") + 1).alias("line_no"), "line")


def log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def asset(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("path"), F.length("html").alias("n_chars"),
        F.sha2("html", 256).alias("sha"))


# --- text forms, for the cross-engine checks ---------------------------------------------------------

_SEQ = "(SELECT * FROM range({n}) t({c}))"


def _lattice_sql(prefix: str, clip: str, width: int, height: int) -> str:
    y, x = (("l_partkey % 8", "CAST(floor(l_partkey/8e0) AS BIGINT) % 8") if (width, height) == (8, 8)
            else (f"CAST(floor(l_partkey/{width}e0) AS BIGINT) % {height}", f"l_partkey % {width}"))
    return f"""{prefix}dims AS (SELECT DISTINCT {clip} AS clip_id FROM lineitem),
{prefix}hits AS (SELECT {clip} AS clip_id, 1 + l_orderkey % 6 AS frame_no, {y} AS y, {x} AS x,
  CAST(sum(l_quantity) AS BIGINT) % 8 AS n FROM lineitem GROUP BY 1,2,3,4),
{prefix}raster AS (SELECT d.clip_id, f.frame_no, yy.y, xx.x, coalesce(h.n,0) AS n,
  ((xx.x + f.frame_no)*23 + yy.y*11 + d.clip_id*29) % 200 AS base
  FROM {prefix}dims d CROSS JOIN (SELECT i+1 AS frame_no FROM range(6) t(i)) f
  CROSS JOIN {_SEQ.format(n=height, c='y')} yy CROSS JOIN {_SEQ.format(n=width, c='x')} xx
  LEFT JOIN {prefix}hits h ON h.clip_id=d.clip_id AND h.frame_no=f.frame_no AND h.y=yy.y AND h.x=xx.x)"""


def _px_sql(prefix: str) -> str:
    return f"""{prefix}px AS (SELECT clip_id, frame_no, y, x,
  CASE WHEN clip_id % 3 = 0 AND frame_no >= 4 THEN 255-base-n ELSE base+n END AS r,
  CASE WHEN clip_id % 3 = 0 AND frame_no >= 4 THEN 40 ELSE base+n END AS g,
  CASE WHEN clip_id % 3 = 0 AND frame_no >= 4 THEN 230 ELSE 100+n END AS b FROM {prefix}raster)"""


_TRACK = """track AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no,
  -6e0 + (CASE WHEN event_type='error' THEN 4e0 ELSE 0e0 END) AS vx, round(value)/8e0 AS vy,
  (22 + event_id % 42)/64e0 AS confidence, ts, event_type FROM events)"""

# name -> (names it needs, text)
FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "raster": ((), _lattice_sql("", "l_suppkey", 8, 8)),
    "wraster": ((), _lattice_sql("w", "CAST(floor(l_suppkey/25e0) AS BIGINT)", 48, 32)),
    "px": (("raster",), _px_sql("")),
    "wpx": (("wraster",), _px_sql("w")),
    "flow": (("raster",), """flow AS (SELECT clip_id, frame_no, y, x, CASE WHEN n=7 THEN -5e0 ELSE -1e0 END AS vx,
  CASE WHEN n=7 THEN 2e0 ELSE 0e0 END AS vy,
  CASE WHEN n=7 THEN 0.125e0 ELSE (32 + (clip_id*7 + frame_no*5 + y*3 + x) % 32)/64e0 END AS confidence,
  CASE WHEN x + (CASE WHEN n=7 THEN -5 ELSE -1 END) < 0 THEN 0e0 ELSE 1e0 END AS visibility,
  CASE WHEN n=7 THEN 0.875e0 ELSE 0.125e0 END AS uncertainty FROM raster)"""),
    "wflow": (("wraster",), """wflow AS (SELECT clip_id, frame_no, y, x,
  CASE WHEN n=7 THEN -4e0 ELSE 1e0 + (x-24)/64e0 END AS vx, CASE WHEN n=7 THEN 2e0 ELSE (y-16)/64e0 END AS vy,
  CASE WHEN n=7 THEN 0.125e0 ELSE (40 + (clip_id*7 + frame_no*5 + y*3 + x) % 24)/64e0 END AS confidence,
  CASE WHEN n=6 THEN 0.5e0 ELSE 1e0 END AS visibility,
  CASE WHEN n=7 THEN 0.875e0 ELSE (4 + (clip_id*7 + frame_no*5 + y*3 + x) % 16)/64e0 END AS uncertainty,
  CASE WHEN n=5 THEN 0.5e0 ELSE 0e0 END AS disocclusion,
  CASE WHEN n=4 THEN 0.5e0 ELSE 0e0 END AS occlusion FROM wraster)"""),
    "wdepth": (("wraster",), """wdepth AS (SELECT clip_id, frame_no, y, x,
  CASE WHEN x>=16 AND x<32 AND y>=8 AND y<24 THEN 0.25e0 ELSE 0.5e0 + y/256e0 END AS d FROM wraster)"""),
    "mchan": (("wraster",), """mchan AS (SELECT clip_id AS seq_id, frame_no, c.channel, y, x,
  CASE c.channel WHEN 'A' THEN 1e0 WHEN 'B' THEN n/8e0 WHEN 'G' THEN 0e0 ELSE CASE WHEN n=7 THEN 3e0 ELSE 1e0 END END AS value
  FROM wraster CROSS JOIN (SELECT unnest(['A','B','G','R']) AS channel) c)"""),
    "grid": (("raster",), """gridm AS (SELECT clip_id, frame_no, CAST(floor(y/2e0) AS BIGINT) AS gy,
  CAST(floor(x/2e0) AS BIGINT) AS gx, CAST(sum(n) AS BIGINT) % 8 AS m FROM raster GROUP BY 1,2,3,4),
grid AS (SELECT clip_id, frame_no, gy, gx, CASE WHEN m=7 THEN -160 ELSE -32 END AS fx, 0 AS fy,
  CASE WHEN m=6 THEN 0 ELSE 32 END AS bx, 0 AS by_, CASE WHEN m=7 THEN 250 ELSE 8 END AS cost_f, 8 AS cost_b FROM gridm)"""),
    "track": ((), _TRACK),
    "paths": (("track",), """paths AS (SELECT track_id, frame_no, concat('/render/t', CAST(track_id AS VARCHAR), '/shot_',
  lpad(CAST(1000+frame_no AS VARCHAR),4,'0'), CASE WHEN frame_no % 11 = 0 THEN '.EXR' ELSE '.exr' END) AS path
  FROM track WHERE event_type <> 'error')"""),
    "stage": ((), """stage AS (SELECT user_id % 7 AS clip_id, event_id AS frame_no, round(value*8)/8e0 AS decode_ms,
  round(value*3)/8e0 AS flow_ms, (event_id % 9)/4e0 AS denoise_ms, ts FROM events)"""),
    "chan": ((), """chan AS (SELECT label AS seq_id, vec_id AS frame_no, c.channel, yy.y, xx.x,
  CASE WHEN c.channel='A' THEN 1e0 WHEN c.channel='R' THEN 100e0 + 8e0*x + 4e0*y + 2e0*(vec_id % 16)
  WHEN c.channel='G' THEN (x+y)/16e0 ELSE 0e0 END AS value
  FROM embeddings CROSS JOIN (SELECT unnest(['A','B','G','R']) AS channel) c
  CROSS JOIN (SELECT * FROM range(8) t(y)) yy CROSS JOIN (SELECT * FROM range(8) t(x)) xx)"""),
    "tile": ((), """tile AS (SELECT vec_id, CAST(floor(i/8e0) AS BIGINT) AS y, i % 8 AS x, CAST(embedding[i+1] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""),
    "probe": ((), """probe AS (SELECT c_custkey AS clip_id, k.line_no, CASE k.line_no
  WHEN 1 THEN concat('width=', CAST(320 + 16*(c_custkey % 9) AS VARCHAR))
  WHEN 2 THEN concat('height=', CAST(180 + 9*(c_custkey % 9) AS VARCHAR))
  WHEN 3 THEN CASE WHEN c_custkey % 2=0 THEN 'avg_frame_rate=30000/1001' ELSE 'avg_frame_rate=24/1' END
  WHEN 4 THEN CASE WHEN c_custkey % 3=0 THEN 'nb_frames=N/A' ELSE concat('nb_frames=', CAST(100+c_custkey AS VARCHAR)) END
  WHEN 5 THEN concat('duration=', CAST(1 + c_custkey % 30 AS VARCHAR))
  WHEN 6 THEN CASE WHEN c_custkey % 5=0 THEN 'codec_name=[libaom-av1 @ x] Failed' ELSE concat('codec_name= ', c_mktsegment) END
  ELSE 'codec_tag_string=av01' END AS line
  FROM customer CROSS JOIN (SELECT i+1 AS line_no FROM range(7) t(i)) k)"""),
    "log": ((), """log AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i+1] AS line
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""),
    "asset": ((), """asset AS (SELECT page_id, url AS path, length(html) AS n_chars, sha256(html) AS sha FROM pages)"""),
}


def with_fixtures(*names: str) -> str:
    """``WITH`` clause defining the named views and everything they need."""
    done: list[str] = []

    def add(n: str) -> None:
        needs, text = FIXTURE_SQL[n]
        for m in needs:
            add(m)
        if text not in done:
            done.append(text)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(done)
