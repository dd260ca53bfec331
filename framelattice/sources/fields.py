"""Field tables: schemas, plane and long layouts, telemetry sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import KEYS

_ID = [("clip_id", T.LongType()), ("frame_no", T.LongType())]
_AT = [("y", T.LongType()), ("x", T.LongType())]


def _schema(*parts) -> T.StructType:
    return T.StructType([T.StructField(n, t) for part in parts for n, t in part])


def _doubles(*names):
    return [(n, T.DoubleType()) for n in names]


PX_SCHEMA = _schema(_ID, _AT, [(c, T.LongType()) for c in "rgb"])
FLOW_SCHEMA = _schema(_ID, _AT, _doubles("vx", "vy", "confidence", "visibility", "uncertainty",
                                         "disocclusion", "occlusion"))
DEPTH_SCHEMA = _schema(_ID, _AT, _doubles("d"))
CLIP_SCHEMA = _schema(
    [("clip_id", T.LongType()), ("width", T.LongType()), ("height", T.LongType())], _doubles("fps", "duration_s"),
    [("total_frames", T.LongType()), ("has_audio", T.BooleanType())],
    [(c, T.StringType()) for c in ("codec", "profile", "pix_fmt")])

# Column order of the three telemetry tables.
TEMPORAL_LOG = (
    "frame scene_score scene_cut avg_mv_px avg_confidence repaired_fraction local_mode_repair_fraction "
    "affine_fallback_fraction global_mv_x global_mv_y temporal_consensus_fraction temporal_consensus_residual "
    "temporal_consensus_history spatial_consensus_fraction spatial_consensus_residual nr_safe_corrected_fraction "
    "nr_history_rejected_fraction mean_history_visibility disoccluded_fraction occlusion_ambiguous_fraction "
    "high_uncertainty_fraction reset denoise_hist_w denoise_spatial_w denoise_reject denoise_age").split()
STAGE_LOG = ("frame decode_ms flow_ms denoise_ms depth_ms depth_stabilize_ms motion_consensus_ms neural_ms "
             "output_stabilize_ms encode_ms total_ms").split()
FG_LOG = "real_frame scene_score scene_cut generated fallback output_frames".split()


def read_long(spark, path: str, schema: T.StructType) -> DataFrame:
    """Long layout: one row per cell. The schema is declared, so pruning and pushdown need no inference."""
    return spark.read.schema(schema).parquet(path)


# Frames decoded per columnar batch. The default of 4096 rows is meant for scalars: with planes of
# megapixels it would ask for gigabytes before the first frame comes out.
PLANES_PER_BATCH = 4


def short_batches(spark, frames: int = PLANES_PER_BATCH) -> None:
    """Lowers the session's columnar batch for plane tables; jobs that also scan long tables should use another session."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", frames)


def read_planes(spark, path: str) -> DataFrame:
    """Plane layout: one row per frame with row-major arrays or packed binaries.

    Frames of megapixels need short columnar batches, which is a setting of the session and the caller's choice: see
    ``short_batches``.
    """
    return spark.read.parquet(path)


def planes_to_long(planes: DataFrame, fields: list[str], width, keys=KEYS) -> DataFrame:
    """One row per frame with row-major arrays -> one row per cell."""
    w = F.lit(width) if isinstance(width, int) else F.col(width) if isinstance(width, str) else width
    zipped = F.arrays_zip(*[F.col(f) for f in fields])
    out = planes.select(*keys, w.alias("_w"), F.posexplode(zipped).alias("_pos", "_v"))
    return out.select(*keys, F.floor(F.col("_pos") / F.col("_w")).cast("bigint").alias("y"),
                      (F.col("_pos") % F.col("_w")).cast("bigint").alias("x"),
                      *[F.col(f"_v.{f}").alias(f) for f in fields])


def _field(name: str):
    return lambda s: s[name]


def long_to_planes(cells: DataFrame, fields: list[str], keys=KEYS) -> DataFrame:
    """One row per cell -> one row per frame, each field a row-major array.

    Image rows are packed first and frames from rows, both after one exchange on the frame: what is
    sorted and held at once is one image row of cells, then one frame of plain arrays.
    """
    rows = cells.repartition(*keys).groupBy(*keys, "y").agg(
        F.array_sort(F.collect_list(F.struct("x", *fields))).alias("_row"))
    rows = rows.select(*keys, "y", *[F.transform("_row", _field(f)).alias(f) for f in fields])
    frames = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", *fields))).alias("_rows"))
    return frames.select(*keys, *[F.flatten(F.transform("_rows", _field(f))).alias(f) for f in fields])


def write_telemetry(df: DataFrame, columns: list[str], path: str, fmt: str = "parquet", partition: str = "clip_id",
                    headers: dict[str, str] | None = None) -> None:
    """Telemetry sink: one folder and file per clip, columns in the published order.

    ``headers`` renames columns on the way out, for readers that expect other names.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"telemetry columns missing: {missing}")
    names = headers or {}
    rows = df.select(partition, *[F.col(c).alias(names.get(c, c)) for c in columns]).repartition(partition)
    # Only the folders of the clips at hand are replaced.
    w = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))


def write_temporal_log(df: DataFrame, path: str, fmt: str = "parquet", headers: dict[str, str] | None = None) -> None:
    write_telemetry(df, TEMPORAL_LOG, path, fmt, headers=headers)


def write_stage_log(df: DataFrame, path: str, fmt: str = "parquet", headers: dict[str, str] | None = None) -> None:
    write_telemetry(df, STAGE_LOG, path, fmt, headers=headers)


def write_fg_log(df: DataFrame, path: str, fmt: str = "parquet", headers: dict[str, str] | None = None) -> None:
    write_telemetry(df, FG_LOG, path, fmt, headers=headers)
