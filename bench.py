"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Besides the registered queries it measures the denoiser's pixel rate on larger frames: the wide
raster's clips set side by side, read as planes from parquet, because the published figure is for
720p frames and not for 48x32 ones.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "d03_scene_segments", "c04_warp_reject", "c06_pyramid_quarter", "c07_neighborhood_stats", "d09_channel_stats",
    "d13_calibrate_motion", "e01_block_match", "e07_grid_reliability", "e08_fit_affine_motion", "e09_repair_rejected_auto",
    "e12_fuse_coarse_auto", "f02_stabilize_output", "f03_temporal_denoise", "f04_trajectory_consensus", "f07_expand_timeline",
    "d15_stage_rollup",
]


def session():
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
            .config("spark.sql.shuffle.partitions", str(CPUS)).config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())


def timed(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def denoise_rate(spark) -> dict:
    """Megapixels per second of the recursive denoiser over mosaic frames."""
    from pyspark.sql import functions as F

    from framelattice.operators import scans as S
    from framelattice.sources import fixtures as fx
    from framelattice.sources.fields import long_to_planes, read_planes, short_batches

    cols, rows, copies = 13, 11, 64  # 13 x 11 tiles of 48 x 32: 624 x 352
    w, h = 48 * cols, 32 * rows
    cells = fx.wide_px(spark, SF_DIR).join(
        fx.wide_flow(spark, SF_DIR).select("clip_id", "frame_no", "y", "x", "vx", "vy", "confidence"), ["clip_id", "frame_no", "y", "x"])
    n = cells.agg(F.max("clip_id") + 1).first()[0]
    # Every mosaic tile shows one clip; the mosaics of different copies start at different clips.
    tiles = spark.range(cols * rows * 2).select(
        F.floor(F.col("id") / (cols * rows)).alias("m"), (F.col("id") % (cols * rows)).alias("t")).withColumn(
        "clip_id", (F.col("t") * 7 + F.col("m") * 3) % n)
    big = cells.join(tiles, "clip_id").select(
        F.col("m").alias("clip_id"), "frame_no", (F.floor(F.col("t") / cols) * 32 + F.col("y")).alias("y"),
        (F.col("t") % cols * 48 + F.col("x")).alias("x"), *[F.col(c).cast("float").alias(c) for c in ("r", "g", "b", "vx", "vy", "confidence")])
    fields = ["r", "g", "b", "vx", "vy", "confidence"]
    planes = long_to_planes(big, fields)
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    planes.write.parquet(f"{base}/one")
    short_batches(spark)
    many = read_planes(spark, f"{base}/one").select("*", F.explode(F.sequence(F.lit(0), F.lit(copies // 2 - 1))).alias("k"))
    many.select((F.col("clip_id") * 1000 + F.col("k")).cast("long").alias("clip_id"), F.col("frame_no").cast("long").alias("frame_no"),
                F.lit(1).cast("long").alias("scene_id"), (F.col("frame_no") == 1).alias("cut"), *fields).transform(
        S.pack_planes, fields).repartition(CPUS * 2, "clip_id").write.parquet(f"{base}/planes")
    src = read_planes(spark, f"{base}/planes")
    spark.conf.set("spark.sql.shuffle.partitions", str(CPUS * 4))  # scenes are few and uneven: spread them wide
    pixels = copies * 6 * w * h
    timed(S.temporal_denoise(src.where("clip_id % 1000 = 0"), w, h, dtype="packed"))
    sec = timed(S.temporal_denoise(src, w, h, dtype="packed"))
    return {"seconds": round(sec, 3), "megapixels": round(pixels / 1e6, 2), "mpx_per_s": round(pixels / 1e6 / sec, 2), "frame": f"{w}x{h}"}


def main() -> None:
    from framelattice.plans import registry

    registry.load_all()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        times[name] = round(timed(registry.QUERIES[name](spark, SF_DIR)), 3)
    rate = denoise_rate(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS, "denoise": rate}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
