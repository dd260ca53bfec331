"""Queries over sources, sinks and catalogue operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..common import big, checkpoint_root, r6
from ..sources import catalog as C
from ..sources import fields, fixtures as fx
from ..sources.fixtures import with_fixtures
from .registry import query
from .sqltext import filled

_PARSED = """p AS (SELECT path, regexp_extract(path,'^(.*)/[^/]*$',1) AS dir,
  regexp_extract(regexp_extract(path,'([^/]*)$',1),'^(.*?)([0-9]+)\\.[^.]*$',1) AS prefix,
  regexp_extract(regexp_extract(path,'([^/]*)$',1),'^(.*?)([0-9]+)\\.[^.]*$',2) AS digits,
  regexp_extract(path,'(\\.[^.]*)$',1) AS suffix FROM paths),
q AS (SELECT *, CAST(digits AS BIGINT) AS number, length(digits) AS padding FROM p WHERE lower(suffix)='.exr' AND digits<>''),
s AS (SELECT *, first_value(number) OVER w AS first_number, first_value(padding) OVER w AS first_padding
  FROM q WINDOW w AS (PARTITION BY dir, prefix ORDER BY number, padding))"""


@query("a01_discover_sequences", with_fixtures("paths") + "," + _PARSED + """
SELECT dir, prefix, number, padding, suffix, path, row_number() OVER (PARTITION BY dir, prefix ORDER BY number, path) AS ordinal
FROM s WHERE number >= first_number AND padding >= first_padding""")
def discover_sequences(spark, d):
    return C.discover_sequences(fx.paths(spark, d)).select(
        "dir", "prefix", "number", "padding", "suffix", "path", "ordinal")


@query("a02_expected_path", with_fixtures("track") + """
SELECT track_id, frame_no, concat('/r/', CAST(track_id AS VARCHAR), '/f_',
  CASE WHEN length(CAST(90+frame_no AS VARCHAR)) >= 2 + track_id % 3 THEN CAST(90+frame_no AS VARCHAR)
       ELSE lpad(CAST(90+frame_no AS VARCHAR), CAST(2 + track_id % 3 AS INT), '0') END, '.exr') AS path FROM track""")
def expected_path(spark, d):
    t = fx.track(spark, d)
    return t.select("track_id", "frame_no", C.expected_path(
        F.concat(F.lit("/r/"), F.col("track_id").cast("string")), F.lit("f_"), F.lit(91), 2 + F.col("track_id") % 3,
        F.lit(".exr"), F.col("frame_no") - 1).alias("path"))


def _missing_sql(lag: int) -> str:
    return with_fixtures("track", "paths") + f""",
want AS (SELECT track_id AS clip_id, frame_no, concat('/render/t', CAST(track_id AS VARCHAR), '/shot_',
  CAST(1001 + frame_no - {lag} AS VARCHAR), '.exr') AS path FROM track WHERE frame_no >= {lag})
SELECT clip_id, frame_no, path FROM want WHERE NOT EXISTS (SELECT 1 FROM paths f WHERE f.path = want.path)"""


def _missing(spark, d, direction):
    clips = fx.track(spark, d).groupBy(F.col("track_id").alias("clip_id")).agg(F.max("frame_no").alias("total_frames"))
    seqs = clips.select(
        "clip_id", F.concat(F.lit("/render/t"), F.col("clip_id").cast("string")).alias("dir"), F.lit("shot_").alias("prefix"),
        F.lit(1001).alias("first_number"), F.lit(4).alias("padding"), F.lit(".exr").alias("suffix"))
    return C.missing_frames(clips, seqs, fx.paths(spark, d), direction)


@query("a03_missing_frames", _missing_sql(1))
def missing_frames(spark, d):
    return _missing(spark, d, "current_to_previous")


@query("a03_missing_frames_forward", _missing_sql(2))
def missing_frames_forward(spark, d):
    return _missing(spark, d, "previous_to_current")


@query("a04_even_sample", with_fixtures("track") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) - 1 AS rn,
  count(*) OVER (PARTITION BY track_id) AS n FROM track),
want AS (SELECT DISTINCT track_id, CAST(round(i*(n-1)/8e0) AS BIGINT) AS rn FROM n, range(9) t(i) WHERE n > 9)
SELECT n.track_id, n.frame_no, n.vx, n.vy FROM n LEFT JOIN want w ON w.track_id=n.track_id AND w.rn=n.rn
WHERE n.n <= 9 OR w.rn IS NOT NULL""")
def even_sample(spark, d):
    return C.even_sample(fx.track(spark, d), ["track_id"], ["frame_no"], 9).select("track_id", "frame_no", "vx", "vy")


@query("a05_stride_sample_finite", with_fixtures("chan") + """
SELECT seq_id, frame_no, channel, y, x, value FROM
(SELECT seq_id, frame_no, channel, y, x, CASE WHEN channel='G' AND y=x THEN 'nan'::DOUBLE ELSE value END AS value FROM chan)
WHERE (y*8+x) % 4 = 0 AND NOT isnan(value) AND NOT isinf(value)""")
def stride_sample_finite(spark, d):
    c = fx.chan(spark, d).withColumn("value", F.when((F.col("channel") == "G") & (F.col("y") == F.col("x")),
                                                     float("nan")).otherwise(F.col("value")))
    return C.stride_sample_finite(c, "value", 8, 8, 16).select("seq_id", "frame_no", "channel", "y", "x", "value")


def _align(spark, d, direction):
    files = fx.flow(spark, d).where("uncertainty < 0.5")
    return C.align_guidance(fx.raster(spark, d).select("clip_id", "frame_no", "y", "x", "n"), files,
                            ["vx", "confidence"], direction)


def _align_sql(shift: int) -> str:
    files = f"(SELECT clip_id, frame_no+{shift} AS frame_no, y, x, vx, confidence FROM flow WHERE uncertainty < 0.5)"
    return (with_fixtures("flow") + " SELECT clip_id, frame_no, y, x, n, coalesce(vx,0e0) AS vx, coalesce(confidence,0e0) AS confidence FROM ("
            + filled("raster", files, ["n"], ["vx", "confidence"]) + ")")


@query("a06_align_guidance", _align_sql(0))
def align_guidance(spark, d):
    return _align(spark, d, "current_to_previous")


@query("a06_align_guidance_forward", _align_sql(1))
def align_guidance_forward(spark, d):
    return _align(spark, d, "previous_to_current")


@query("a07_validate_dimensions", with_fixtures("chan") + """
SELECT seq_id AS clip_id, frame_no, max(x)+1 AS got_width, max(y)+1 AS got_height, count(*) AS cells,
  CASE WHEN seq_id % 4 = 0 THEN 16 ELSE 8 END AS width, 8 AS height FROM chan WHERE channel='R'
GROUP BY seq_id, frame_no HAVING max(x)+1 <> CASE WHEN seq_id % 4 = 0 THEN 16 ELSE 8 END OR max(y)+1 <> 8""")
def validate_dimensions(spark, d):
    f = fx.chan(spark, d).where("channel = 'R'").withColumnRenamed("seq_id", "clip_id")
    clips = f.select("clip_id").distinct().select(
        "clip_id", F.when(F.col("clip_id") % 4 == 0, 16).otherwise(8).alias("width"), F.lit(8).alias("height"))
    return C.validate_dimensions(f, clips)


@query("a07_validate_channels", with_fixtures("chan") + """,
asked AS (SELECT seq_id, role, CASE WHEN role='depth' AND seq_id%3=1 THEN NULL WHEN role='depth' THEN 'R' WHEN seq_id%5=2 THEN 'motion.Z' ELSE 'R' END AS channel
  FROM (SELECT DISTINCT seq_id FROM chan) CROSS JOIN (VALUES ('depth'),('motion')) t(role))
SELECT a.seq_id, a.role, a.channel FROM asked a LEFT JOIN (SELECT DISTINCT seq_id, channel FROM chan) c ON c.seq_id=a.seq_id AND c.channel=a.channel WHERE c.channel IS NULL""")
def validate_channels(spark, d):
    """Every third sequence has no depth channel chosen, every fifth a motion channel that it does not have."""
    c = fx.chan(spark, d).select("seq_id", "channel").distinct()
    seqs = c.select("seq_id").distinct().withColumns({
        "depth": F.when(F.col("seq_id") % 3 != 1, F.lit("R")), "motion": F.when(F.col("seq_id") % 5 == 2, F.lit("motion.Z")).otherwise(F.lit("R"))})
    return C.validate_channels(seqs, c, ["depth", "motion"]).select("seq_id", "role", "channel")


@query("a07_validate_depth_range", with_fixtures("wflow") + """,
r AS (SELECT clip_id, frame_no, CASE WHEN clip_id%2=0 THEN 'fixed_range' ELSE 'auto' END AS mapping, min(vx) AS near, CASE WHEN frame_no%3=0 THEN min(vx) ELSE max(vx) END AS far FROM wflow GROUP BY 1,2)
SELECT clip_id, frame_no, CASE WHEN mapping='fixed_range' AND NOT far>near THEN 'fixed range requires far > near' END AS fault FROM r""")
def validate_depth_range(spark, d):
    far = F.when(F.col("frame_no") % 3 == 0, F.min("vx")).otherwise(F.max("vx"))
    r = fx.wide_flow(spark, d).groupBy("clip_id", "frame_no").agg(F.min("vx").alias("near"), far.alias("far"))
    mapping = F.when(F.col("clip_id") % 2 == 0, "fixed_range").otherwise("auto")
    return r.select("clip_id", "frame_no", C.validate_depth_range(mapping, F.col("near"), F.col("far")).alias("fault"))


@query("a08_probe_to_clips", with_fixtures("probe") + """,
kv AS (SELECT clip_id, line_no, substr(line,1,instr(line,'=')-1) AS k, substr(line,instr(line,'=')+1) AS v FROM probe),
a AS (SELECT clip_id, arg_max(TRY_CAST(v AS BIGINT), line_no) FILTER (WHERE k='width') AS width,
  arg_max(TRY_CAST(v AS BIGINT), line_no) FILTER (WHERE k='height') AS height,
  arg_max(TRY_CAST(split_part(v,'/',1) AS DOUBLE)/TRY_CAST(split_part(v,'/',2) AS DOUBLE), line_no) FILTER (WHERE k='avg_frame_rate') AS fps,
  arg_max(TRY_CAST(v AS BIGINT), line_no) FILTER (WHERE k='nb_frames' AND v<>'N/A') AS nb,
  arg_max(TRY_CAST(v AS DOUBLE), line_no) FILTER (WHERE k='duration') AS duration_s,
  arg_max(lower(trim(v)), line_no) FILTER (WHERE k='codec_name' AND regexp_full_match(lower(trim(v)),'[a-z0-9_.-]{1,64}')) AS codec,
  arg_max(v, line_no) FILTER (WHERE k='codec_tag_string') AS tag FROM kv GROUP BY clip_id)
SELECT clip_id, width, height, round(fps,6) AS fps, duration_s, coalesce(nb, CAST(round(duration_s*fps) AS BIGINT)) AS total_frames,
  coalesce(codec, CASE WHEN tag='av01' THEN 'av1' END) AS codec FROM a""")
def probe_to_clips(spark, d):
    return C.probe_to_clips(fx.probe(spark, d)).select(
        "clip_id", "width", "height", F.round("fps", 6).alias("fps"), "duration_s", "total_frames", "codec")


@query("a09_first_passing", """
WITH a AS (SELECT c_custkey AS clip_id, i+1 AS prio, ['soft','gpu_a','gpu_b','native','last'][i+1] AS name,
  (c_custkey + (i+1)*3) % 7 = 0 AS passed FROM customer, range(5) t(i)),
s AS (SELECT *, min(prio) FILTER (WHERE passed) OVER (PARTITION BY clip_id) AS stop FROM a)
SELECT clip_id, arg_min(name, prio) FILTER (WHERE passed) AS chosen, count(*) AS attempts,
  string_agg(name || CASE WHEN passed THEN ':ok' ELSE ':failed' END, ',' ORDER BY prio) AS trail
FROM s WHERE stop IS NULL OR prio <= stop GROUP BY clip_id""")
def first_passing(spark, d):
    names = F.array(*[F.lit(n) for n in ("soft", "gpu_a", "gpu_b", "native", "last")])
    a = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), F.posexplode(names).alias("pos", "name"))
    a = a.withColumn("prio", F.col("pos") + 1).withColumn("passed", (F.col("clip_id") + F.col("prio") * 3) % 7 == 0)
    return C.first_passing(a)


@query("a09b_advertised", with_fixtures("log") + """,
t AS (SELECT string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS w FROM log)
SELECT DISTINCT w[1] AS name FROM t WHERE w[1] IN (SELECT w[2] FROM t WHERE w[2] IS NOT NULL)""")
def advertised(spark, d):
    lines = fx.log(spark, d)
    names = lines.select(F.get(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), F.lit(0)).alias("name")).distinct()
    return C.advertised(lines, names)


@query("a10_compact_log", with_fixtures("log") + """,
t AS (SELECT doc_id, line_no, ltrim(rtrim(line, ' '||chr(9)||chr(13)||chr(10)), ' '||chr(9)) AS line FROM log),
f AS (SELECT doc_id, line, min(line_no) AS line_no FROM t WHERE line <> '' GROUP BY 1,2),
r AS (SELECT *, row_number() OVER w AS ordinal, sum(strlen(line)) OVER w AS chars FROM f
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, ordinal, line_no, line, CAST(chars AS BIGINT) AS chars FROM r WHERE ordinal <= 12 AND chars <= 2800""")
def compact_log(spark, d):
    return C.compact_log(fx.log(spark, d))


@query("a11_asset_manifest", with_fixtures("asset") + """,
crit AS (SELECT path FROM asset WHERE n_chars % 5 = 0 UNION SELECT path || '.sig' FROM asset WHERE n_chars % 7 = 0)
SELECT c.path, a.n_chars AS bytes, a.sha AS sha256, a.sha IS NULL AS missing,
  (SELECT count(*) FROM asset) AS file_count, (SELECT CAST(sum(n_chars) AS BIGINT) FROM asset) AS total_bytes
FROM crit c LEFT JOIN asset a ON a.path = c.path""")
def asset_manifest(spark, d):
    files = fx.asset(spark, d).select("path", F.col("n_chars").alias("bytes"), F.col("sha").alias("sha256"))
    critical = files.where("bytes % 5 = 0").select("path").unionByName(
        files.where("bytes % 7 = 0").select(F.concat("path", F.lit(".sig")).alias("path")))
    return C.asset_manifest(files, critical)


@query("a12_write_stage_log", with_fixtures("stage") + """
SELECT clip_id, frame_no AS frame, decode_ms, flow_ms, denoise_ms, decode_ms + flow_ms + denoise_ms AS total_ms FROM stage""")
def write_stage_log(spark, d):
    """Telemetry sink and source round trip."""
    s = fx.stage(spark, d)
    zero = ["depth_ms", "depth_stabilize_ms", "motion_consensus_ms", "neural_ms", "output_stabilize_ms", "encode_ms"]
    s = s.withColumn("frame", F.col("frame_no")).withColumn("total_ms", F.col("decode_ms") + F.col("flow_ms") + F.col("denoise_ms"))
    s = s.withColumns({c: F.lit(0.0) for c in zero})
    path = f"{checkpoint_root(spark)}/stage-log-{uuid.uuid4().hex}"
    fields.write_stage_log(s, path)
    return spark.read.parquet(path).select(
        big("clip_id").alias("clip_id"), "frame", "decode_ms", "flow_ms", "denoise_ms", "total_ms")


@query("a13_plane_long_round_trip", with_fixtures("tile") + " SELECT vec_id, y, x, v FROM tile")
def plane_long(spark, d):
    planes = fields.long_to_planes(fx.tile(spark, d), ["v"], ["vec_id"])
    return fields.planes_to_long(planes, ["v"], 8, ["vec_id"])


@query("a13_plane_source", with_fixtures("tile") + " SELECT vec_id, y, x, v FROM tile")
def plane_source(spark, d):
    return fields.planes_to_long(fx.tile_planes(spark, d), ["plane"], 8, ["vec_id"]).withColumnRenamed("plane", "v")


@query("a13_long_source", with_fixtures("wflow") + """
SELECT clip_id, frame_no, count(*) AS cells, round(avg(confidence),6) AS mean_confidence FROM wflow WHERE confidence>=.5e0 GROUP BY 1,2""")
def long_source(spark, d):
    """A long table written once and read back by its declared schema: the filter and two columns reach the scan."""
    path = f"{checkpoint_root(spark)}/flow-{uuid.uuid4().hex}"
    names = fields.FLOW_SCHEMA.fieldNames()
    fx.wide_flow(spark, d).select(*[F.col(c).cast(fields.FLOW_SCHEMA[c].dataType) for c in names]).write.parquet(path)
    f = fields.read_long(spark, path, fields.FLOW_SCHEMA).where("confidence >= 0.5")
    return f.groupBy("clip_id", "frame_no").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg("confidence")).alias("mean_confidence"))
