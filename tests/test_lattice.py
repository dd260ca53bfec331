import numpy as np
import pytest
from pyspark.sql import functions as F

from framelattice.operators import calibration as K
from framelattice.operators import lattice as L
from framelattice.operators import pairs as P
from framelattice.operators import preview as V
from framelattice.sources import catalog as C


def test_planes_and_row_pairs_give_the_same_lookup(cells):
    rng = np.random.default_rng(0)
    src = cells(13, 9, 2, v=rng.normal(size=(2, 9, 13)))
    q = cells(13, 9, 2, sx=rng.uniform(-3, 16, (2, 9, 13)), sy=rng.uniform(-3, 12, (2, 9, 13)))
    for border in ("clamp", "reject", "flag"):
        a, b = (L.sample_bilinear(q, src, {"v": "s"}, "sx", "sy", 13, 9, border, access=m) for m in ("planes", "rows"))
        assert a.count() == b.count() == q.count()
        assert a.exceptAll(b).count() == 0


def test_inversion_is_the_same_by_planes_and_by_rows(cells):
    rng = np.random.default_rng(1)
    f = cells(12, 10, vx=rng.uniform(-2, 2, (10, 12)), vy=rng.uniform(-2, 2, (10, 12)))
    a = L.invert_flow(f, 12, 10).collect()
    b = L.invert_flow(f, 12, 10, access="rows").collect()
    key = lambda r: (r.y, r.x)
    for p, q in zip(sorted(a, key=key), sorted(b, key=key)):
        assert p == q


def test_pyramid_sizes_and_flat_images(cells):
    y, x = np.indices((4, 8))
    p = cells(8, 4, r=x * 20, g=y * 40, b=80)
    half, quarter = L.pyramid_down(p, ["r", "g", "b"], 1).toPandas(), L.pyramid_down(p, ["r", "g", "b"], 2).toPandas()
    assert len(half) == 8 and half.x.max() == 3 and half.y.max() == 1
    assert len(quarter) == 2 and (half.b == 80).all() and (quarter.b == 80).all()


def test_preview_scale_and_size(cells):
    vx = np.full((32, 64), 2.0)
    vx[5, 5] = 1000.0
    f = cells(64, 32, vx=vx, vy=0.0)
    assert V.robust_magnitude(f).first().robust_magnitude == 2.0
    assert V.robust_magnitude(cells(64, 32, vx=4.0, vy=0.0), -2.0, 0.5).first().robust_magnitude == 8.0
    right = V.motion_preview(cells(64, 32, vx=4.0, vy=0.0), 64, 32, max_width=32)
    down = V.motion_preview(cells(64, 32, vx=0.0, vy=4.0), 64, 32, max_width=32)
    assert right.count() == 32 * 16
    a, b = right.first(), down.first()
    assert (a.r, a.g, a.b) != (b.r, b.g, b.b)
    # a void vector is black
    dark = V.motion_preview(cells(4, 4, vx=float("nan"), vy=0.0), 4, 4).first()
    assert (dark.r, dark.g, dark.b) == (0, 0, 0)


def test_gates_tell_duplicates_from_motion(cells):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 255, (30, 52))
    still = cells(48, 30, 2, v=np.stack([base[:, :48], base[:, :48]]))
    moved = cells(48, 30, 2, v=np.stack([base[:, :48], base[:, 4:52]]))
    zero, four = cells(48, 30, 2, vx=0.0, vy=0.0, confidence=1.0), cells(48, 30, 2, vx=4.0, vy=0.0, confidence=0.5)
    s = P.stability_gates(P.flow_stats(zero, still)).first()
    assert s.near_duplicate and not s.needs_rescue
    m = P.stability_gates(P.flow_stats(four, moved)).first()
    assert not m.near_duplicate and m.needs_rescue


@pytest.mark.parametrize("forward", [False, True])
def test_motion_calibration_finds_channel_sign_and_direction(cells, spark, forward):
    """A textured block over a flat ground moves; R holds its motion, A is constant."""
    w, h, n = 64, 48, 6
    y, x = np.indices((h, w))
    frames, motion = [], []
    pos = [8 + (f * f if forward else 2 * f) for f in range(n)]
    for f in range(n):
        img = np.full((h, w), 90)
        inb = (x >= pos[f]) & (x < pos[f] + 24) & (y >= 8) & (y < 40)
        img[inb] = ((7 * (x - pos[f]) + 11 * (y - 8)) & 255)[inb]
        frames.append(img)
        step = (pos[f + 1] - pos[f] if f + 1 < n else 0) if forward else -2
        motion.append(np.where(inb, step, 0.0))
    px = cells(w, h, n, r=np.stack(frames), g=np.stack(frames), b=np.stack(frames))
    ch = None
    for name, v in (("A", 1.0), ("B", 0.0), ("G", 0.0), ("R", np.stack(motion))):
        c = cells(w, h, n, value=v).select(F.col("clip_id").alias("seq_id"), "frame_no", F.lit(name).alias("channel"), "y", "x",
                                           F.col("value").cast("double").alias("value"))
        ch = c if ch is None else ch.unionByName(c)
    channels = spark.createDataFrame([(1, c, i) for i, c in enumerate("ABGR")], "seq_id long, channel string, ordinal int")
    r = K.calibrate_motion_sequence(px, ch, channels, w, h).first()
    assert r.success and r.x_channel == "R" and r.best_error < r.zero_error
    assert r.direction == ("previous_to_current" if forward else "current_to_previous")
    if not forward:
        assert r.unit == "pixels" and not r.flip_x


def test_static_clip_is_inconclusive(cells, spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 255, (24, 36))
    px = cells(36, 24, 3, r=np.stack([a, a + (np.indices((24, 36))[1] % 3), a]), g=a, b=a)
    ch = None
    for name in "AR":
        c = cells(36, 24, 3, value=1.0).select(F.col("clip_id").alias("seq_id"), "frame_no", F.lit(name).alias("channel"), "y", "x", "value")
        ch = c if ch is None else ch.unionByName(c)
    channels = spark.createDataFrame([(1, "A", 0), (1, "R", 1)], "seq_id long, channel string, ordinal int")
    r = K.calibrate_motion_sequence(px, ch, channels, 36, 24).first()
    assert r is None or not r.success


def test_depth_calibration_prefers_the_metric_channel(spark):
    rows = [(1, f, c, y, x, {"A": 1.0, "B": 0.0, "G": 0.0, "R": 100.0 + 8 * x + 4 * y + 2 * f}[c])
            for f in range(12) for c in "ABGR" for y in range(6) for x in range(8)]
    df = spark.createDataFrame(rows, "seq_id long, frame_no long, channel string, y long, x long, value double")
    assert K.calibrate_depth(K.channel_stats(df, 8, 6, max_frames=9)).first().sampled_frames == 9
    r = K.calibrate_depth(K.channel_stats(df, 8, 6)).first()
    assert r.success and r.channel == "R" and r.mapping == "fixed_range" and r.sampled_frames == 12 and 100 <= r.near < r.far


def test_sequence_paths(spark):
    df = spark.createDataFrame([("/a/shot_1001.exr",), ("/a/shot_1026.exr",), ("/b/render.000001.EXR",), ("/b/render.exr",), ("/a/x.png",)], "path string")
    got = {r.path: (r.prefix, r.number, r.padding, r.suffix) for r in C.discover_sequences(df).collect()}
    assert got["/a/shot_1001.exr"] == ("shot_", 1001, 4, ".exr") and got["/b/render.000001.EXR"] == ("render.", 1, 6, ".EXR")
    assert len(got) == 3
    p = spark.range(1).select(C.expected_path(F.lit("/a"), F.lit("shot_"), F.lit(1001), F.lit(4), F.lit(".exr"), F.lit(25)).alias("p"),
                              C.expected_path(F.lit("/a"), F.lit("s"), F.lit(99), F.lit(2), F.lit(".exr"), F.lit(1)).alias("q")).first()
    assert p.p == "/a/shot_1026.exr" and p.q == "/a/s100.exr"


def test_even_sample_matches_rounding(spark):
    for n, k in ((5, 9), (100, 9), (17, 4), (12, 1)):
        df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i"))
        got = sorted(r.i for r in C.even_sample(df, ["g"], ["i"], k).collect())
        want = list(range(n)) if n <= k or k <= 1 else sorted({int(np.floor(i * (n - 1) / (k - 1) + 0.5)) for i in range(k)})
        assert got == want


def test_validation_and_probe_errors(spark):
    r = spark.range(1).select(C.validate_depth_range(F.lit("fixed_range"), F.lit(2.0), F.lit(1.0)).alias("bad"),
                              C.validate_depth_range(F.lit("fixed_range"), F.lit(0.0), F.lit(1.0)).alias("ok")).first()
    assert r.bad and r.ok is None
    lines = spark.createDataFrame([(1, 1, "width=10"), (1, 2, "avg_frame_rate=0/0"), (2, 1, "height=3")], "clip_id long, line_no long, line string")
    assert {(r.clip_id, r.error) for r in C.probe_errors(lines).collect()} == {(1, "no resolution"), (2, "no resolution")}
    seqs = spark.createDataFrame([(1, "R", None)], "seq_id long, x string, y string")
    ch = spark.createDataFrame([(1, "R")], "seq_id long, channel string")
    assert [r.role for r in C.validate_channels(seqs, ch, ["x", "y"]).collect()] == ["y"]
