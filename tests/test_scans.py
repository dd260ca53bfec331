import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelattice.operators import consensus as C
from framelattice.operators import pairs as P
from framelattice.operators import scans as S
from framelattice.operators import telemetry as T
from framelattice.sources.fields import long_to_planes, planes_to_long, read_planes


def field(vx, conf, h=32, w=64, vis=1.0, unc=None, dis=0.0, gx=None):
    one = lambda v: np.full((h, w), float(v))
    return {"vx": one(vx), "vy": one(0), "confidence": one(conf), "visibility": one(vis), "uncertainty": one(1 - conf if unc is None else unc),
            "disocclusion": one(dis), "global_x": np.array([vx if gx is None else gx]), "global_y": np.array([0.0])}


def centre(r):
    return r["vx"].reshape(32, 64)[16, 32]


def test_auto_corrects_a_phase_slip():
    step = C.plane_step(64, 32, "auto", 4)
    assert step(False, field(-6, 0.92))["corrected_fraction"] == 0
    r = step(False, field(-2, 0.58, gx=-6))
    assert r["corrected_fraction"] > 0 and centre(r) < -2.4


def test_strong_corrects_confident_slips_and_resets_on_cuts():
    step = C.plane_step(64, 32, "strong", 4)
    for _ in range(3):
        step(False, field(-6, 0.94))
    slip = field(-2, 0.93, gx=-6)
    r = step(False, slip)
    assert r["corrected_fraction"] > 0 and centre(r) < -3.0 and r["history"] >= 2
    assert step(True, slip)["corrected_fraction"] == 0
    assert step(False, slip)["corrected_fraction"] == 0


def test_acceleration_is_followed_and_revealed_surfaces_are_left_alone():
    step = C.plane_step(64, 32, "strong", 2)
    for v in (-2, -4, -6):
        step(False, field(v, 0.95))
    assert abs(centre(step(False, field(-8, 0.95))) + 8) < 0.6
    step = C.plane_step(64, 32, "strong", 4)
    for _ in range(3):
        step(False, field(-6, 0.95, unc=0.10))
    r = step(False, field(-2, 0.60, vis=0.0, unc=0.95, dis=1.0))
    assert r["corrected_fraction"] == 0 and abs(centre(r) + 2) < 1e-4


def test_denoiser_reduces_noise_and_forgets_across_cuts():
    rng = np.random.default_rng(1)
    w, h = 64, 48
    step = S.denoise_step(w, h, S.Denoise(strength=0.9, history=0.92, spatial=0.32, detail=0.72))
    noisy = lambda m, s: {c: np.clip(np.round(rng.normal(m, s, h * w)), 0, 255) for c in "rgb"}
    still = {"vx": np.zeros(h * w), "vy": np.zeros(h * w), "confidence": np.ones(h * w)}
    rmse = lambda p: np.sqrt(np.mean([(np.asarray(p[c]).ravel() - 128) ** 2 for c in "rgb"]))
    a, b = [], []
    for f in range(12):
        frame = noisy(128, 18)
        out = step(f == 0, {**frame, **still})
        a.append(rmse(frame))
        b.append(rmse(out))
    assert np.mean(b) < 0.80 * np.mean(a)
    assert step(True, {**noisy(220, 3), **still})["r"].mean() >= 200


def denoise_reference(k, cur, hist, age, vx, vy, conf):
    """Cell-by-cell evaluation of the filter, written separately from the array code."""
    h, w, _ = cur.shape
    ycc = lambda c: np.array([0.25 * c[0] + 0.5 * c[1] + 0.25 * c[2], 0.5 * c[0] - 0.5 * c[2], -0.25 * c[0] + 0.5 * c[1] - 0.25 * c[2]])
    out, ages = np.zeros_like(cur), np.ones((h, w))
    for y in range(h):
        for x in range(w):
            near = [(oy, ox, cur[min(max(y + oy, 0), h - 1), min(max(x + ox, 0), w - 1)]) for oy in (-1, 0, 1) for ox in (-1, 0, 1)]
            yc = [ycc(c / 255) for _, _, c in near]
            here = ycc(cur[y, x] / 255)
            lo, hi = np.min(yc, axis=0), np.max(yc, axis=0)
            wts = np.array([(1, .72, .52)[abs(oy) + abs(ox)] * np.exp(-abs(q[0] - here[0]) / max(.004, .018 + .085 * k.strength))
                            for (oy, ox, _), q in zip(near, yc)])
            soft = sum(wt * c for wt, (_, _, c) in zip(wts, near)) / wts.sum() / 255
            sigma = np.std([q[0] for q in yc])
            t = np.clip((hi[0] - lo[0] - .025) / .16, 0, 1)
            edge = t * t * (3 - 2 * t)
            src = cur[y, x] / 255
            ap = k.spatial * k.strength * (1 - edge * k.detail)
            base = src + (soft - src) * ap
            hw = 0.0
            px, py = x + vx[y, x], y + vy[y, x]
            if hist is not None and 0 <= px <= w - 1 and 0 <= py <= h - 1 and conf[y, x] >= .08:
                x0, y0 = int(px), int(py)
                x1, y1, tx, ty = min(w - 1, x0 + 1), min(h - 1, y0 + 1), px - x0, py - y0
                top = hist[y0, x0] + (hist[y0, x1] - hist[y0, x0]) * tx
                bot = hist[y1, x0] + (hist[y1, x1] - hist[y1, x0]) * tx
                q = ycc((top + (bot - top) * ty) / 255)
                ey, ec = k.expansion + .7 * sigma, 1.35 * k.expansion + .45 * sigma
                q = np.clip(q, lo - [ey, ec, ec], hi + [ey, ec, ec])
                pa = age[int(np.floor(py + .5)), int(np.floor(px + .5))]
                hw = (k.history * k.strength * conf[y, x] * np.exp(-((q[0] - here[0]) / k.luma_reject) ** 2)
                      * np.exp(-(max(abs(q[1] - here[1]), abs(q[2] - here[2])) / k.chroma_reject) ** 2)
                      * (.72 + .28 * np.exp(-np.hypot(vx[y, x], vy[y, x]) / 36)) * np.clip(pa / 6, .2, 1) * (1 - .36 * edge * k.detail))
                hw = min(hw, .965)
                if hw > .01:
                    rgb = np.clip([q[0] + q[1] - q[2], q[0] + q[2], q[0] - q[1] - q[2]], 0, 1)
                    base = base + (rgb - base) * hw
                    ages[y, x] = min(k.max_age, pa + 1)
            base = base + (src - base) * (ap * hw * .55)
            out[y, x] = np.clip(np.floor(base * 255 + .5), 0, 255)
    return out, ages


def test_denoiser_equals_cell_by_cell_evaluation():
    rng = np.random.default_rng(7)
    h, w, k = 9, 11, S.Denoise()
    step, hist, age = S.denoise_step(w, h, k), None, None
    base = rng.integers(60, 190, (h, w, 3))
    for f in range(5):
        cur = np.clip(base + rng.integers(-12, 12, (h, w, 3)), 0, 255).astype(float)
        vx, vy, conf = rng.uniform(-2, 2, (h, w)), rng.uniform(-2, 2, (h, w)), rng.uniform(0, 1, (h, w))
        got = step(f == 0, {**{c: cur[..., i].ravel() for i, c in enumerate("rgb")}, "vx": vx.ravel(), "vy": vy.ravel(), "confidence": conf.ravel()})
        want, ages = denoise_reference(k, cur, hist, age, vx, vy, conf)
        g = np.stack([got[c] for c in "rgb"], -1)
        assert np.abs(g - want).max() <= 1 and (g != want).mean() < 0.02  # 32-bit against 64-bit rounding
        assert (got["age"] != ages).mean() < 0.02
        hist, age = g.astype(float), np.asarray(got["age"], float)  # keep both on the same history


def video(cells, frames=5):
    rng = np.random.default_rng(3)
    h, w = 12, 18
    i = np.arange(frames * h * w).reshape(frames, h, w)
    y, x = np.indices((h, w))
    return cells(w, h, frames, **{c: rng.integers(0, 255, (frames, h, w)) for c in "rgb"}, vx=np.sin(x / 7.0), vy=np.cos(y / 5.0),
                 confidence=0.35 + 0.65 * (i % 97) / 96), w, h


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_does_not_depend_on_partitions_or_layout(cells, spark, parts, tmp_path):
    c, w, h = video(cells)
    c = c.unionByName(c.withColumn("clip_id", F.lit(2)).withColumn("r", 255 - F.col("r")))
    seg = c.select("clip_id", "frame_no").distinct().withColumn("cut", F.col("frame_no").isin(1, 4)).withColumn(
        "scene_id", F.when(F.col("frame_no") >= 4, 2).otherwise(1).cast("long"))
    fields = ["r", "g", "b", "vx", "vy", "confidence"]
    planes = S.scene_planes(c.repartition(parts), fields, seg, "float")
    one = S.temporal_denoise(S.scene_planes(c, fields, seg, "float"), w, h)
    two = S.temporal_denoise(planes, w, h)
    key = ["clip_id", "frame_no"]
    a, b = (d.orderBy(key).toPandas() for d in (one, two))
    for col in ("r", "g", "b", "age"):
        assert all(np.array_equal(p, q) for p, q in zip(a[col], b[col]))
    path = str(tmp_path / "planes")
    S.pack_planes(planes, fields).write.parquet(path)
    p = S.temporal_denoise(read_planes(spark, path), w, h, dtype="packed").orderBy(key).toPandas()
    assert all(np.array_equal(np.frombuffer(x, np.uint8), y.astype(np.uint8)) for x, y in zip(p["r"], a["r"]))


def test_out_of_order_frames_are_refused(cells, spark):
    c, w, h = video(cells, 3)
    seg = c.select("clip_id", "frame_no").distinct().select("*", F.lit(False).alias("cut"), F.lit(1).cast("long").alias("scene_id"))
    planes = S.scene_planes(c, ["r", "g", "b", "vx", "vy", "confidence"], seg, "float")
    twice = planes.unionByName(planes.where("frame_no = 2"))
    with pytest.raises(Exception, match="out of order"):
        S.temporal_denoise(twice, w, h).collect()


def test_plane_round_trip(cells):
    c, w, _ = video(cells, 2)
    back = planes_to_long(long_to_planes(c, ["r", "vx"]), ["r", "vx"], w)
    assert back.exceptAll(c.select("clip_id", "frame_no", "y", "x", "r", "vx")).count() == 0


def test_rate_limit_keeps_the_greedy_choice(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(t)) for k in range(3) for t in np.unique(rng.integers(0, 4000, 400))]
    df = spark.createDataFrame(rows, "k long, t double")
    got = {(r.k, r.t) for r in T.rate_limit(df, "k", "t", 25.0).collect()}
    want = set()
    for k in range(3):
        last = -1e9
        for t in sorted(t for kk, t in rows if kk == k):
            if t - last >= 25:
                want.add((k, t))
                last = t
    assert got == want


def test_timeline_has_n_times_m_slots(spark):
    seg = spark.createDataFrame([(1, f, f in (1, 4)) for f in range(1, 8)], "clip_id long, frame_no long, cut boolean")
    for m in (2, 3, 6):
        t = T.expand_timeline(seg, m).orderBy("output_index").toPandas()
        assert list(t.output_index) == list(range(1, 7 * m + 1))
        assert (t.kind == "real").sum() == 7 and (t.kind == "duplicate").sum() == m - 1 and (t.kind == "fallback").sum() == m - 1
    assert T.expand_timeline(seg, 4, enabled=False).count() == 7


def test_size_change_counts_as_a_cut(cells):
    a = cells(8, 8, 2, v=100)
    b = cells(16, 8, 1, first=3, v=100)
    s = {r.frame_no: r.score for r in P.scene_cut_score(a.unionByName(b)).collect()}
    assert s[1] == 1.0 and s[2] == 0.0 and s[3] == 1.0


def test_telemetry_sinks_keep_order_and_rename(spark, tmp_path):
    from framelattice.sources import fields as S

    df = spark.range(3).select(F.lit(1).alias("clip_id"), *[F.col("id").alias(c) for c in S.FG_LOG])
    S.write_fg_log(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).columns == [*S.FG_LOG, "clip_id"]
    S.write_fg_log(df, str(tmp_path / "b"), "csv", {"generated": "made"})
    assert "made" in spark.read.option("header", True).csv(str(tmp_path / "b")).columns
    with pytest.raises(ValueError):
        S.write_stage_log(df, str(tmp_path / "c"))
