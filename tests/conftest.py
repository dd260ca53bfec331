import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cells(spark):
    """cells(width, height, frames, **fields): a lattice table; a field is a constant, an (h, w) or an (f, h, w) array."""

    def make(width, height, frames=1, clip=1, first=1, **fields):
        f, y, x = np.indices((frames, height, width))
        data = {"clip_id": np.full(f.size, clip), "frame_no": f.ravel() + first, "y": y.ravel(), "x": x.ravel()}
        for k, v in fields.items():
            data[k] = np.broadcast_to(np.asarray(v), f.shape).ravel()
        return spark.createDataFrame(pd.DataFrame(data))

    return make


@pytest.fixture(scope="session")
def plane():
    """plane(df, column, frame): the (h, w) array of one frame."""

    def get(df, column, frame=1):
        p = df.where(f"frame_no = {frame}").select("y", "x", column).toPandas()
        return p.pivot(index="y", columns="x", values=column).to_numpy()

    return get
