"""Robust motion magnitude and colour previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import KEYS, big, finite, hypot
from ..functions.colour import depth_gray, motion_hsv
from .lattice import resample_nearest

# Order statistic shown at full brightness, its floor.
ORDER_SHARE = 0.95
MIN_DISPLAY = 0.25


def robust_magnitude(flow: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, keys=KEYS) -> DataFrame:
    """Per frame, the magnitude at sorted index floor((m-1) * .95) of all its finite vectors.

    A lower order statistic, not interpolated. A window sorts one frame at a time and spills.
    """
    vx, vy = F.col("vx") * scale_x, F.col("vy") * scale_y
    m = flow.select(
        *keys, F.when(finite(vx) & finite(vy), hypot(vx, vy)).alias("m"))
    w = W.partitionBy(*keys)
    ranked = m.where("m IS NOT NULL").withColumn("rn", F.row_number().over(w.orderBy("m"))).withColumn(
        "n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rn") == F.floor((F.col("n") - 1) * ORDER_SHARE) + 1).select(
        *keys, F.col("m").alias("robust_magnitude"), big("n").alias("samples"))


def preview_height(width: int, height: int, out_width: int) -> int:
    return max(1, int(height * out_width / width + 0.5))


def motion_preview(flow: DataFrame, width: int, height: int, scale_x: float = 1.0, scale_y: float = 1.0,
                   max_width: int = 960, keys=KEYS) -> DataFrame:
    """Downscaled direction/magnitude colours of every frame, plus its robust magnitude."""
    ow = max(1, min(width, max_width))
    oh = preview_height(width, height, ow)
    scale = robust_magnitude(flow, scale_x, scale_y, keys)
    small = resample_nearest(flow.select(*keys, "y", "x", "vx", "vy"), width, height, ow, oh)
    d = small.join(scale, list(keys), "left").withColumn("robust_magnitude", F.coalesce("robust_magnitude", F.lit(0.0)))
    colour = motion_hsv(F.col("vx") * scale_x, F.col("vy") * scale_y, F.greatest(F.lit(MIN_DISPLAY), F.col("robust_magnitude")))
    return d.withColumn("c", colour).select(*keys, "y", "x", "c.r", "c.g", "c.b", F.lit(255).alias("a"), "robust_magnitude")


def depth_preview(depth: DataFrame, keys=KEYS) -> DataFrame:
    g = depth_gray(F.col("d"))
    return depth.select(*keys, "y", "x", g.alias("r"), g.alias("g"), g.alias("b"), F.lit(255).alias("a"))
