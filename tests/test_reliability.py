import numpy as np
import pytest
from pyspark.sql import functions as F

from framelattice.operators import motion as M
from framelattice.operators import reliability as R


def packed(cells, gw, gh, fwd, back, cost=8, cost_b=8):
    f = lambda v: np.round(np.asarray(v) * 32).astype(int)
    g = cells(gw, gh, fx=f(fwd[0]), fy=f(fwd[1]), bx=f(back[0]), by_=f(back[1]), cost_f=cost, cost_b=cost_b)
    return g.withColumnsRenamed({"y": "gy", "x": "gx"})


def relate(cells, grid, w, h, gw, gh):
    px = cells(w, h, r=0, g=0, b=0)
    return R.grid_reliability(grid, px, w, h, gw, gh, photometric=False).cache()


def test_consistent_pair_is_trusted_and_edges_are_disoccluded(cells, plane):
    out = relate(cells, packed(cells, 4, 2, (-3.0, 0.5), (3.0, -0.5)), 8, 4, 4, 2)
    assert np.allclose(plane(out, "vx"), -3.0) and np.allclose(plane(out, "vy"), 0.5)
    assert plane(out, "confidence")[1, 6] > 0.90 and plane(out, "visibility")[1, 6] > 0.70 and plane(out, "uncertainty")[1, 6] < 0.35
    assert plane(out, "disocclusion")[1, 0] > 0.95 and plane(out, "visibility")[1, 0] < 0.05
    bad = relate(cells, packed(cells, 4, 2, (-3.0, 0.5), (0.0, 0.0)), 8, 4, 4, 2)
    assert plane(bad, "confidence").mean() < plane(out, "confidence").mean() - 0.15
    assert plane(bad, "uncertainty").mean() > plane(out, "uncertainty").mean() + 0.10
    safe = R.safe_motion(out, 8, 4, "auto", 2)
    assert plane(safe, "confidence")[1, 0] == 0.0


def test_outlier_is_repaired_and_the_safe_path_moves_less(cells, plane):
    fx, bx = np.full((4, 8), -4.0), np.full((4, 8), 4.0)
    cost = np.full((4, 8), 4)
    fx[1, 4], bx[1, 4], cost[1, 4] = -12.0, 0.0, 250
    out = relate(cells, packed(cells, 8, 4, (fx, 0.0), (bx, 0.0), cost, cost), 16, 8, 8, 4)
    rep = R.repair_rejected(out, 16, 8, "strong", 2).cache()
    assert rep.where("repaired is not null").count() > 0
    raw, fixed = plane(out, "vx")[3, 9], plane(rep, "vx")[3, 9]
    assert abs(fixed + 4.0) < 4.0
    safe = R.safe_motion(out, 16, 8, "strong", 2).cache()
    s = plane(safe, "vx")[3, 9]
    assert 0.01 < abs(s - raw) <= abs(fixed - raw) + 1e-4
    assert plane(safe, "confidence")[3, 9] <= plane(out, "confidence")[3, 9] + 1e-5


def test_confident_but_uncertain_vector_is_repaired(cells, plane):
    vx, unc = np.full((12, 20), -4.0), np.full((12, 20), 0.08)
    vx[6, 10], unc[6, 10] = -12.0, 0.95
    f = cells(20, 12, vx=vx, vy=0.0, confidence=0.95, visibility=1.0, disocclusion=0.0, occlusion=0.0, uncertainty=unc)
    out = R.refine_with_depth(f, cells(20, 12, d=0.5), 20, 12, "strong", 1)
    assert abs(plane(out, "vx")[6, 10] + 4.0) < 4.0


def test_affine_fallback_without_local_support(cells, plane):
    w, h = 64, 40
    y, x = np.indices((h, w))
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    vx, vy = 3 + 0.02 * dx + 0.01 * dy, -2 - 0.015 * dx + 0.02 * dy
    cy, cx = h // 2, w // 2
    want = np.array([vx[cy, cx], vy[cy, cx]])
    vx[cy, cx], vy[cy, cx] = 30.0, -20.0
    near = (abs(y - cy) <= 3) & (abs(x - cx) <= 3)
    f = cells(w, h, vx=vx, vy=vy, confidence=np.where(near, 0.05, 0.95), visibility=1.0, disocclusion=0.0, occlusion=0.0,
              uncertainty=np.where(near, 0.95, 0.08))
    m = R.fit_affine_motion(f, w, h, "strong").first()
    assert abs(m.vx0 - 3) < 1e-6 and abs(m.vy0 + 2) < 1e-6
    out = R.refine_with_depth(f, cells(w, h, d=0.5), w, h, "strong", 1).cache()
    got = np.array([plane(out, "vx")[cy, cx], plane(out, "vy")[cy, cx]])
    assert np.hypot(*(got - want)) < 0.45 * np.hypot(30 - want[0], -20 - want[1])
    assert out.where(f"y = {cy} and x = {cx}").first().repaired == "affine"


def test_small_frame_has_a_camera_model(cells):
    """Sixteen cells of every sixth would be too few; all trusted cells count, and those far from the stride's lattice."""
    w = h = 24
    y, x = np.indices((h, w))
    vx, vy = 3 + 0.02 * (x - 11.5) + 0.01 * (y - 11.5), -2 - 0.015 * (x - 11.5)
    conf = np.where((y % 6 == 3) & (x % 6 == 3), 0.05, 0.95)
    m = R.fit_affine_motion(cells(w, h, vx=vx, vy=vy, confidence=conf, visibility=1.0, uncertainty=1 - conf), w, h).first()
    assert m is not None and m.samples == w * h - 16
    assert abs(m.vx0 - 3) < 1e-6 and abs(m.vy0 + 2) < 1e-6 and abs(m.vxx - 0.02 * 12) < 1e-6


def test_cut_frames_carry_no_motion(cells, spark):
    g = packed(cells, 4, 2, (-3.0, 0.5), (3.0, -0.5))
    seg = spark.createDataFrame([(1, 1, True)], "clip_id long, frame_no long, cut boolean")
    out = R.grid_reliability(g, cells(8, 4, r=0, g=0, b=0), 8, 4, 4, 2, segments=seg)
    assert out.where("vx <> 0 or confidence <> 0 or uncertainty <> 1").count() == 0


def test_coarse_scale_pulls_a_slip_and_keeps_raw(cells, plane):
    vx, conf, unc = np.full((4, 8), -4.0), np.full((4, 8), 0.85), np.full((4, 8), 0.20)
    vx[2, 5], conf[2, 5], unc[2, 5] = -12.0, 0.25, 0.92
    full = cells(8, 4, vx=vx, vy=0.0, raw_vx=vx, confidence=conf, uncertainty=unc)
    coarse = cells(4, 2, vx=-2.0, vy=0.0, confidence=0.95, uncertainty=0.10)
    out = M.fuse_coarse(full, coarse, 8, 4, 4, 2, "strong").cache()
    assert out.where("corrected").count() > 0
    assert abs(plane(out, "vx")[2, 5] + 4) < 8 and plane(out, "raw_vx")[2, 5] == -12.0
    assert plane(out, "uncertainty")[2, 5] < 0.92
    d = M.fusion_diagnostics(out).first()
    assert 0 < d.corrected_fraction < 1 and d.mean_residual > 0
    both = M.fusion_diagnostics(out, M.fusion_diagnostics(out)).first()
    assert both.corrected_fraction == pytest.approx(1 - (1 - d.corrected_fraction) ** 2)


def test_isolated_low_confidence_vector_is_conditioned(cells, plane):
    vx, vy, c = np.full((64, 96), -3.0), np.zeros((64, 96)), np.ones((64, 96))
    vx[20, 30], vy[20, 30], c[20, 30] = 18.0, -12.0, 0.0
    f = cells(96, 64, vx=vx, vy=vy, confidence=c)
    out = M.condition_outliers(f).cache()
    assert abs(plane(out, "vx")[20, 30] + 3) < 0.5 and abs(plane(out, "vy")[20, 30]) < 0.5
    assert (plane(out, "vx") != vx).sum() == 1


def test_block_match_finds_a_shift_and_fill_spreads_it(cells):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 255, (40, 70))
    v = np.stack([base[:, 0:64], base[:, 3:67]])  # content moves left by three
    g = cells(64, 40, 2, v=v)
    b = M.block_match(g, 64, 40).toPandas()
    inner = b[(b.gx > 0) & (b.gx < 7) & (b.gy > 0) & (b.gy < 4)]
    assert (inner.vx == 3).all() and (inner.vy == 0).all() and (inner.confidence > 0.8).all()
    grid = cells(3, 3, vx=np.where(np.indices((3, 3))[1] == 1, 0.0, 2.0), vy=0.0,
                 confidence=np.where(np.indices((3, 3))[1] == 1, 0.1, 0.6)).withColumnsRenamed({"y": "gy", "x": "gx"})
    out = M.fill_low_confidence(grid).toPandas()
    assert np.allclose(out.vx, 2.0)
    assert np.allclose(out[out.gx == 1].confidence, 0.6 * 0.55)


def test_forward_motion_is_inverted(cells, plane):
    f = cells(16, 8, mx=3.0, my=0.0)
    px = cells(16, 8, 2, r=10, g=10, b=10)
    out = M.import_external_motion(f, px, 16, 8, direction="previous_to_current").cache()
    assert np.allclose(plane(out, "vx", 2)[:, 6:], -3.0)
    assert (plane(out, "confidence", 2)[:, 6:] == 1.0).all()
    assert (plane(out, "confidence", 1) == 0.0).all()
    assert (plane(out, "vx", 2)[:, 0] == 0.0).all()  # the fixed point leaves the image there


def test_missing_cells_are_no_neighbours_in_frames_of_several_bands(cells):
    """A lattice with holes repairs as the full one whose hole cells have no say; frames are larger than a task's stretch of rows."""
    rng = np.random.default_rng(4)
    w, h = 190, 120
    v = lambda: rng.integers(-3, 4, (2, h, w)) + 0.25 * rng.integers(0, 2, (2, h, w))
    hole = rng.random((2, h, w)) < 0.1
    conf = np.where(hole, 0.0, rng.random((2, h, w)))
    f = cells(w, h, 2, vx=v(), vy=v(), confidence=conf, visibility=1.0, uncertainty=0.125, hole=hole)
    depth = cells(w, h, 2, d=0.25 + 0.5 * (np.arange(w) > 70))
    full = R.repair_rejected(f, w, h, "strong", 2, depth).where("NOT hole").toPandas()
    part = R.repair_rejected(f.where("NOT hole"), w, h, "strong", 2, depth).toPandas()
    key = ["frame_no", "y", "x"]
    full, part = full.sort_values(key).reset_index(drop=True), part.sort_values(key).reset_index(drop=True)
    assert len(part) == (~hole).sum() and (part["repaired"] == "local").sum() > 1000
    for c in part.columns:
        assert (part[c].fillna("") == full[c].fillna("")).all() if c == "repaired" else np.allclose(part[c].astype(float), full[c].astype(float), atol=1e-9)
