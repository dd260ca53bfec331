"""Windowed telemetry while a run is going on, batch stall audit, and stream plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import checkpoint_root, stored
from ..operators.telemetry import STAGES


def stream_stage_means(stage_log: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Stage means and speed per clip and time window; works on streams and tables alike.

    stage_log(clip_id, ts, *_ms, total_ms). In append mode a window is written once, when the watermark closes it; rows more than `late`
    behind then no longer count (Spark reports their number).
    """
    stages = [s for s in STAGES if s in stage_log.columns]
    d = stage_log.withWatermark("ts", late) if stage_log.isStreaming else stage_log
    return d.groupBy(F.window("ts", window).alias("w"), "clip_id").agg(
        F.count(F.lit(1)).alias("frames"), *[F.avg(s).alias(f"avg_{s}") for s in stages],
        F.when(F.sum("total_ms") > 0, 1000.0 * F.count(F.lit(1)) / F.sum("total_ms")).otherwise(0.0).alias("fps"),
    ).select(F.col("w.start").alias("window_start"), "clip_id", "frames", *[f"avg_{s}" for s in stages], "fps")


def stall_audit(frames: DataFrame, seconds: float, key: str = "clip_id", t: str = "t", block: float = 3600.0) -> DataFrame:
    """Pauses longer than allowed between consecutive frames of finished runs.

    Neighbours are found within blocks of time; the last frame of a block goes with the first one of the next block that has any (one row a
    block), so a long run is many tasks.
    """
    d = frames.select(key, F.col(t).alias("last_t"), F.floor(F.col(t) / block).alias("_block"))
    firsts = d.groupBy(key, "_block").agg(F.min("last_t").alias("_first"))
    firsts = firsts.select(key, "_block", F.lead("_first").over(W.partitionBy(key).orderBy("_block")).alias("_after"))
    d = d.withColumn("next_t", F.lead("last_t").over(W.partitionBy(key, "_block").orderBy("last_t"))).join(firsts, [key, "_block"])
    return d.select(key, "last_t", F.coalesce("next_t", "_after").alias("next_t")).where(F.col("next_t") - F.col("last_t") > seconds)


def drain(stream: DataFrame, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over everything there is now and returns what it wrote.

    Progress, state and output live under the shared checkpoint root. Complete output is rewritten
    per batch, appended output is written once.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    out, cp = f"{base}/out", f"{base}/progress"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", cp).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)


def as_stream(df: DataFrame, files: int = 4, by: str | None = None, end: dict | None = None, late: str | None = None) -> DataFrame:
    """A table written as several files (each key in one, if ``by`` and not ``late`` is given) and read back as a file stream, one file per batch.

    end: values of a last row, null elsewhere, in a file after all others: a heartbeat far ahead in event time, which lets the watermark pass
    everything that still waits.
    late: a row comes less than this after its event time `ts`, and files are ranges of when rows come, written one after the other. A stream
    that allows as much gives up no row, however long the table is; without it a row may be in any file, so as late as the table is long.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/source-{uuid.uuid4().hex}"
    if late is not None:
        delay = F.pmod(F.xxhash64(*df.columns), F.lit(1000)) / F.lit(1000.0)
        comes = df.withColumn("_comes", F.col("ts") + F.expr(f"INTERVAL {late}") * delay).repartitionByRange(files, "_comes")
        comes = stored(comes.withColumn("_file", F.spark_partition_id()).drop("_comes"), "arrivals")
        for i in range(files):
            comes.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(path)
    else:
        (df.repartition(files, by) if by else df.repartition(files)).write.parquet(path)
    if end is not None:
        spark.createDataFrame([tuple(end.get(f.name) for f in df.schema)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
