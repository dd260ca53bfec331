import pytest
from pyspark.sql import functions as F

from framelattice.operators import reliability as R
from framelattice.operators.pairs import scene_segments
from framelattice.plans import guidance as G
from framelattice.plans.q_pairs import CUT, scores
from framelattice.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
CELL = ["clip_id", "frame_no", "y", "x"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Field, segments and depth as tables in a folder of their own."""
    at = tmp_path_factory.mktemp("given")
    tables = {"flow": fx.wide_flow(spark, SF).withColumns({"raw_vx": F.col("vx"), "raw_vy": F.col("vy")}),
              "segments": scene_segments(scores(spark, SF, wide=True), CUT), "depth": fx.wide_depth(spark, SF)}
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    return [spark.read.parquet(f"{at}/{name}") for name in tables]


def test_consumers_share_what_is_computed_once(given):
    flow, segments, depth = given
    g = G.guidance_paths(flow, segments, 48, 32, "auto", 4, depth)
    read = G.telemetry(g).inputFiles()
    assert read and not [f for df in given for f in df.inputFiles() if f in read]
    assert g.conservative.columns == [*flow.columns, "corrected", "rejected"]
    assert g.conservative.select(*CELL).exceptAll(flow.select(*CELL)).isEmpty() and g.conservative.count() == flow.count()


def test_depth_may_be_a_column_of_the_field(given):
    flow, _, depth = given
    depth = depth.where("x != 5").withColumn("d", F.when(F.col("x") != 7, F.col("d")))  # some cells without
    joined = flow.join(depth, CELL, "left")
    a = R.repair_rejected(flow, 48, 32, "auto", 4, depth)
    b = R.repair_rejected(joined, 48, 32, "auto", 4, "d")
    assert b.columns == [*joined.columns, "repaired"]
    b = b.drop("d").select(*a.columns)
    assert a.where("repaired IS NOT NULL").count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with pytest.raises(ValueError):
        R.repair_rejected(joined, 48, 32, "auto", 4, "depth")
