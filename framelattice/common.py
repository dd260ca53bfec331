"""Shared column helpers, key names and session utilities."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("clip_id", "frame_no")
CELL = ("clip_id", "frame_no", "y", "x")


def as_col(v) -> Column:
    """A Column as it is, anything else as a literal (strings are literals too)."""
    return v if isinstance(v, Column) else F.lit(v)


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def finite(c: Column) -> Column:
    """True only for real numbers: not null, not NaN, not infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, as_col(lo)), as_col(hi))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def r6(c: Column, digits: int = 6) -> Column:
    """Round for publication; adding zero removes a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def frac(cond: Column) -> Column:
    """Share of the group's rows for which the condition holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


_fallback_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the context or of spark.checkpoint.dir; a temporary one in local mode alone."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    root = known.get() if known.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _fallback_roots:
        _fallback_roots[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_roots[sc.applicationId]


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of an iterated plan (survives executor loss)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stored-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application: tasks import it. Not needed where it is installed or on PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in on_path or root.name == "site-packages" or app in _shipped:
        return
    _shipped.add(app)
    base = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/framelattice"
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "framelattice"))
