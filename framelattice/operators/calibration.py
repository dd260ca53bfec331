"""Depth and motion calibration: ranked hypotheses over sampled guidance channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import KEYS, big, clamp01, finite
from ..functions.colour import luma
from ..functions.names import convention_penalty, depth_name_prior, leaf, motion_name_prior
from ..sources.catalog import even_sample, on_stride
from .pairs import informative_pairs, pair_mad

# Fixed values.
QUANTILES = (0.001, 0.01, 0.10, 0.50, 0.90, 0.99, 0.999)
QUANTILE_NAMES = ("p001", "p01", "p10", "p50", "p90", "p99", "p999")
FACTORS = (0.25, 0.5, 1.0, 2.0, 4.0)
RESIDUAL_CAP = 0.35
CONVENTIONS = 120


def sample_frames(chan: DataFrame, max_frames: int) -> DataFrame:
    """Evenly spaced frames of each sequence."""
    frames = chan.select("seq_id", "frame_no").distinct()
    return even_sample(frames, ["seq_id"], ["frame_no"], max_frames)


def exact_quantiles(d: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], parts: int = 64) -> DataFrame:
    """Interpolated quantiles ``q`` of each group's non-null values, without holding a group in one task's memory.

    A sketch cuts each group into parts. Counts say in which parts the wanted ranks lie; only those parts are sorted, each
    in a window of its own, which spills.
    """
    d = d.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = d.groupBy(*keys).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10000).alias("_cuts"), F.count("*").alias("_n"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    d = d.join(cuts, keys).withColumn("_part", part).drop("_cuts")
    counts = d.groupBy(*keys, "_part").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    w = W.partitionBy(*keys).orderBy("_part")  # at most ``parts`` rows a group
    counts = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in shares])))
    held = counts.withColumn("_want", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).where(F.size("_want") > 0)
    row = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_v")) - 1
    found = d.drop("_n").join(held.drop("_c"), [*keys, "_part"]).withColumn("_rank", F.col("_before") + row).where(F.array_contains("_want", F.col("_rank")))
    per = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"), F.max("_n").alias("_n"))  # two entries a share at most

    def at(p: float) -> Column:
        r = (F.col("_n") - 1) * p
        lo, hi = F.element_at("_m", F.floor(r)), F.element_at("_m", F.ceil(r))
        return lo + (hi - lo) * (r - F.floor(r))

    return per.select(*keys, F.array(*[at(p) for p in shares]).alias("q"))


def channel_stats(chan: DataFrame, width: int, height: int, max_frames: int | None = None, max_values: int | None = None,
                  approximate: bool = False) -> DataFrame:
    """Robust statistics and depth-likeness score of every channel of every sequence.

    All frames and cells count unless a sample is asked for: max_frames evenly spaced frames, about max_values cells of a
    frame. Quantiles are exact; ``approximate`` takes them from a sketch in one pass.
    """
    frames = chan.select("seq_id", "frame_no").distinct() if max_frames is None else sample_frames(chan, max_frames)
    counted = frames.groupBy("seq_id").agg(F.count(F.lit(1)).alias("frames"))
    d = chan if max_values is None else chan.where(on_stride(width, height, max_values))
    d = d if max_frames is None else d.join(frames, ["seq_id", "frame_no"], "left_semi")
    v = F.when(finite(F.col("value")), F.col("value"))
    per_frame = width * height if max_values is None else min(max_values, width * height)
    s = d.groupBy("seq_id", "channel").agg(
        *([F.percentile_approx(v, list(QUANTILES), 100000).alias("q")] if approximate else []), big(F.count(v)).alias("finite_count"),
        F.avg(F.when(v.isNotNull(), F.when(v >= 0.0, 1.0).otherwise(0.0))).alias("positive_ratio"),
        F.avg(F.when(v.isNotNull(), F.when((v >= -1e-5) & (v <= 1.00001), 1.0).otherwise(0.0))).alias("in01_ratio"))
    s = s.join(counted, "seq_id")
    if not approximate:
        s = s.join(exact_quantiles(d.withColumn("value", v), ["seq_id", "channel"], "value", QUANTILES), ["seq_id", "channel"], "left")
    s = s.select("seq_id", "channel", "finite_count", "frames", "positive_ratio", "in01_ratio",
                 *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)])
    total = F.greatest(F.col("frames") * per_frame, F.col("finite_count"))
    s = s.withColumn("robust_span", F.col("p99") - F.col("p01")).withColumn(
        "finite_ratio", F.col("finite_count") / F.greatest(F.lit(1), total))
    mag = F.greatest(F.lit(1.0), F.abs("p01"), F.abs("p99"))
    score = (
        depth_name_prior(F.col("channel")) + clamp01(F.col("finite_ratio")) * 2.0 + clamp01(F.col("positive_ratio")) * 1.5
        + F.least(F.greatest(F.col("robust_span") / mag * 5.0, F.lit(0.0)), F.lit(3.0))
        - F.when(F.col("robust_span") <= F.greatest(F.lit(1e-7), mag * 1e-6), 12.0).otherwise(0.0)
        - F.when((leaf(F.col("channel")) == "a") & (F.col("in01_ratio") > 0.99), 6.0).otherwise(0.0)
    )
    return s.withColumn("score", F.when(F.col("finite_count") > 0, score).otherwise(-1000.0))


def calibrate_depth(stats: DataFrame) -> DataFrame:
    """Best depth channel per sequence, its mapping, one global range and a confidence."""
    w = W.partitionBy("seq_id").orderBy(F.desc("score"), "channel")
    top = stats.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    # at most two rows per sequence meet here
    best = top.groupBy("seq_id").agg(
        F.min_by(F.struct(*[c for c in stats.columns if c != "seq_id"]), "rank").alias("b"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    b = lambda c: F.col(f"b.{c}")
    raw = (b("in01_ratio") >= 0.995) & (b("p001") >= -1e-4) & (b("p999") <= 1.0001)
    use_wide = ~(finite(b("p01")) & finite(b("p99")) & (b("p99") > b("p01")))
    name = clamp01((depth_name_prior(b("channel")) + 2.0) / 10.0)
    span = clamp01(b("robust_span") / F.greatest(F.lit(1e-6), F.abs(b("p99"))) * 3.0)
    separation = F.when(F.col("second").isNull(), 1.0).otherwise(clamp01((b("score") - F.col("second") + 1.0) / 6.0))
    conf = clamp01(0.35 * b("finite_ratio") + 0.25 * span + 0.20 * name + 0.20 * separation)
    ok = F.coalesce((b("finite_count") > 0) & (b("robust_span") > 1e-12), F.lit(False))
    when = lambda c: F.when(ok, c)
    return best.select(
        "seq_id", ok.alias("success"), when(b("channel")).alias("channel"),
        when(F.when(raw, "raw01").otherwise("fixed_range")).alias("mapping"),
        when(F.when(raw, 0.0).when(use_wide, b("p001")).otherwise(b("p01"))).alias("near"),
        when(F.when(raw, 1.0).when(use_wide, b("p999")).otherwise(b("p99"))).alias("far"),
        when(conf).alias("confidence"), when(b("frames")).alias("sampled_frames"))


# ---------------------------------------------------------------------------------------------


def on_lattice(step: int) -> Column:
    """Every step-th cell from the middle of the first step on, both ways."""
    return F.lit(True) if step == 1 else (F.col("y") % step == step // 2) & (F.col("x") % step == step // 2)


def capped_residual(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b) / 255.0, F.lit(RESIDUAL_CAP)) / RESIDUAL_CAP


def zero_motion_error(px: DataFrame, pairs: DataFrame, step: int = 1) -> DataFrame:
    """Per clip, the mean over its pairs of the residual a motionless image would leave."""
    l = px.where(on_lattice(step)).select(*KEYS, "y", "x", luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    cur = l.join(pairs.select(*KEYS), list(KEYS), "left_semi")
    prev = l.select("clip_id", (F.col("frame_no") + 1).alias("frame_no"), "y", "x", F.col("l").alias("p"))
    j = cur.join(prev, [*KEYS, "y", "x"])
    per = j.groupBy(*KEYS).agg(F.avg(capped_residual(F.col("p"), F.col("l"))).alias("e"))
    return per.groupBy("clip_id").agg(F.avg("e").alias("zero_error"), F.count(F.lit(1)).alias("sampled_pairs"))


def limit_motion_channels(channels: DataFrame, max_channels: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Channels by how likely they are motion components, or only the likeliest if so asked; ties keep listing order."""
    c = F.col("channel")
    prior = F.greatest(motion_name_prior(c, "x"), motion_name_prior(c, "y"))
    w = W.partitionBy("seq_id").orderBy(prior.desc(), ordinal)
    d = channels.withColumn("slot", F.row_number().over(w))
    return d if max_channels is None else d.where(F.col("slot") <= max(2, max_channels))


def convention(ordinal: Column, width: int, height: int) -> dict[str, Column]:
    """Interpretation number 0..119: 3 units x 5 factors x 4 signs x 2 directions, in listing order."""
    i = ordinal.cast("int")
    pick = lambda vals, k: F.get(F.array(*[F.lit(v) for v in vals]), k.cast("int"))
    unit, factor = F.floor(i / 40), F.floor(i / 8) % 5
    scale = pick(FACTORS, factor)
    label = F.concat(pick(("pixels", "UV", "NDC"), unit), pick([f" x{f:g}" if f != 1.0 else "" for f in FACTORS], factor))
    return {
        "sx": pick((1.0, float(width), width * 0.5), unit) * scale, "sy": pick((1.0, float(height), height * 0.5), unit) * scale,
        "flip_x": F.floor(i / 2) % 2 == 1, "flip_y": F.floor(i / 4) % 2 == 1, "forward": i % 2 == 1, "unit": label,
    }


def candidate_grid(channels: DataFrame, width: int, height: int) -> DataFrame:
    """Ordered channel pairs x 3 units x 5 factors x 4 signs x 2 directions.

    channels(seq_id, channel, slot). The pairs are the only theta join, bounded by the channel limit;
    the conventions are a constant array.
    """
    y = channels.select("seq_id", F.col("channel").alias("y_channel"), F.col("slot").alias("y_slot"))
    pairs = channels.select("seq_id", F.col("channel").alias("x_channel"), F.col("slot").alias("x_slot")).join(
        y, "seq_id").where("x_slot <> y_slot")
    return pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(CONVENTIONS - 1))).alias("ordinal")).withColumns(
        convention(F.col("ordinal"), width, height))


class FrameErrors:
    """Residual and motion sums of every convention of every channel pair, for the cells that are projected into one frame's luma plane."""

    schema = "clip_id long, x_slot int, y_slot int, ordinal int, residual double, motion double, n long"
    room = 1 << 26  # bytes of positions at once

    def __init__(self, width: int, height: int, source_width: int, source_height: int):
        self.width, self.height, self.sw, self.sh = width, height, source_width, source_height
        # the scales of ``convention``, in its order
        self.scales = [(u * f, v * f) for u, v in ((1.0, 1.0), (float(source_width), float(source_height)), (source_width * 0.5, source_height * 0.5))
                       for f in FACTORS]

    def _axis(self, at: np.ndarray, value: np.ndarray, scale: float, limit: float, size: int, source: int) -> tuple:
        """Displacement, usable, seen, lower index and fraction along one axis, NaN and infinity being neither."""
        f = value * scale
        usable = np.abs(f) <= 2.0 * limit
        d = np.where(usable, f * (size / source), 0.0)
        q = at + d
        seen = usable & (q >= 0.0) & (q <= size - 1)
        q = np.where(seen, q, 0.0)
        low = q.astype(np.int64)
        return d, usable, seen, low, q - low

    def _corners(self, plane: np.ndarray) -> np.ndarray:
        """Four rows: the plane, its right, lower and diagonal neighbours; the last row and column are their own."""
        p = np.pad(plane.reshape(self.height, self.width), ((0, 1), (0, 1)), "edge")
        return np.stack([p[:-1, :-1].ravel(), p[:-1, 1:].ravel(), p[1:, :-1].ravel(), p[1:, 1:].ravel()])

    def _pair(self, corners: np.ndarray, l: np.ndarray, across: list, down: list) -> np.ndarray:
        """Residual and motion sums, 2 rows of 15 scales by 4 signs, from both axes' positions."""
        out = np.zeros((2, len(self.scales) * 4))
        for k in range(len(self.scales)):
            ax, ay = across[k], down[k]
            usable = ax[0][1] & ay[0][1]
            motion = np.sqrt(ax[0][0] ** 2 + ay[0][0] ** 2)[usable].sum()
            for sign in range(4):
                _, _, seen_x, x0, tx = ax[sign % 2]
                _, _, seen_y, y0, ty = ay[sign // 2]
                at = np.flatnonzero(seen_x & seen_y)
                residual = float(len(l) - len(at))  # what leaves the image counts whole
                if len(at):
                    x0, y0, tx, ty, cur = (x0, y0, tx, ty, l) if len(at) == len(l) else (v.take(at) for v in (x0, y0, tx, ty, l))
                    a, b, c, d = corners.take(y0 * self.width + x0, axis=1)
                    top = a + (b - a) * tx
                    r = np.abs(cur - (top + (c + (d - c) * tx - top) * ty))
                    residual += (np.fmin(r / 255.0, RESIDUAL_CAP) / RESIDUAL_CAP).sum()
                out[:, 4 * k + sign] = residual, motion
        return out

    def _slots(self, cells: pa.Table) -> Iterator[tuple[int, int, pd.DataFrame]]:
        """Ordered pairs of slots with the cells that have both; cells(y, x, l, fwd, v)."""
        v = cells["v"].combine_chunks()
        flat = v.flatten()
        entry = pd.DataFrame({"cell": np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy())), "slot": flat.field("slot").to_numpy(zero_copy_only=False),
                              "v": flat.field("value").to_numpy(zero_copy_only=False).astype(np.float64)})
        by = {int(k): g for k, g in entry.groupby("slot")}
        for a, ga in by.items():
            for b, gb in by.items():
                if a == b:
                    continue
                same = len(ga) == len(gb) and (ga["cell"].to_numpy() == gb["cell"].to_numpy()).all() and ga["cell"].is_unique
                if same:
                    yield a, b, pd.DataFrame({"cell": ga["cell"].to_numpy(), "vx": ga["v"].to_numpy(), "vy": gb["v"].to_numpy()})
                else:
                    yield a, b, ga[["cell", "v"]].merge(gb[["cell", "v"]], on="cell").set_axis(["cell", "vx", "vy"], axis=1)

    def __call__(self, cells: pa.Table, luma_cells: pa.Table) -> pa.Table:
        num = lambda t, c, kind: t[c].to_numpy().astype(kind)
        found = []
        if len(cells) and len(luma_cells):
            plane = np.full(self.width * self.height, np.nan)
            plane[num(luma_cells, "y", np.int64) * self.width + num(luma_cells, "x", np.int64)] = num(luma_cells, "l", np.float64)
            clip = cells["clip_id"][0].as_py()
            corners = self._corners(plane)
            step = max(1024, self.room // 16384)
            for first in range(0, len(cells), step):
                part = cells.slice(first, step)
                y, x, l = (num(part, c, np.float64) for c in ("y", "x", "l"))
                fwd = num(part, "fwd", bool)
                known: dict = {}  # positions by axis, slot and direction, for slots that the same cells have
                for a, b, p in self._slots(part):
                    cell, regular = p["cell"].to_numpy(), np.array_equal(p["cell"], np.arange(len(part)))
                    for way in (False, True):
                        mine = fwd[cell] == way
                        at = cell[mine]
                        if not len(at):
                            continue

                        def axis(name, slot, v, pos, which, limit, size, source):
                            key = (name, slot, way)
                            if not regular or key not in known:
                                known[key] = [[self._axis(pos[at], v, s, limit, size, source) for s in (k[which], -k[which])] for k in self.scales]
                            return known[key] if regular else known.pop(key)

                        across = axis("x", a, p["vx"].to_numpy()[mine], x, 0, self.sw, self.width, self.sw)
                        down = axis("y", b, p["vy"].to_numpy()[mine], y, 1, self.sh, self.height, self.sh)
                        residual, motion = self._pair(corners, l[at], across, down)
                        # even ordinals point back, odd ones forward
                        found.append(pd.DataFrame({"clip_id": clip, "x_slot": a, "y_slot": b, "ordinal": 2 * np.arange(len(residual)) + way,
                                                   "residual": residual, "motion": motion, "n": len(at)}))
        kinds = pa.schema([("clip_id", pa.int64()), ("x_slot", pa.int32()), ("y_slot", pa.int32()), ("ordinal", pa.int32()),
                           ("residual", pa.float64()), ("motion", pa.float64()), ("n", pa.int64())])
        return pa.Table.from_pandas(pd.concat(found), kinds, preserve_index=False) if found else kinds.empty_table()


def motion_candidate_error(px: DataFrame, chan: DataFrame, channels: DataFrame, pairs: DataFrame, width: int, height: int,
                           source_width: int | None = None, source_height: int | None = None, step: int = 1) -> DataFrame:
    """Reprojection residual and mean motion of every convention of every channel pair, per clip.

    px and chan are at analysis resolution (width x height). Lattice samples, every step-th one both ways, meet the frame they are projected
    into, one group a frame; channel pairs and conventions are tried there by arrays over its cells, and only their sums leave the task.
    chan(seq_id = clip_id, frame_no = 1-based file position, channel, y, x, value).
    """
    sw, sh = source_width or width, source_height or height
    l = px.select(*KEYS, "y", "x", luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    use = pairs.select("clip_id", F.col("frame_no").alias("pair"))
    planes = l.join(use.select("clip_id", F.explode(F.array("pair", F.col("pair") - 1)).alias("frame_no")).distinct(),
                    list(KEYS), "left_semi")
    planes = planes.select(*[F.col(c).alias(n) for c, n in (("clip_id", "clip_id"), ("frame_no", "plane_frame"), ("y", "y"), ("x", "x"), ("l", "l"))])
    kept = chan.where(on_lattice(step)).join(channels.select("seq_id", "channel", "slot"), ["seq_id", "channel"])
    # one entry per kept channel
    values = kept.groupBy(F.col("seq_id").alias("clip_id"), "frame_no", "y", "x").agg(
        F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("v"))
    s = l.where(on_lattice(step)).join(values, [*KEYS, "y", "x"])
    # A file at frame f explains pair f when it points back and pair f + 1 when it points forward.
    ways = F.array(
        F.struct(F.col("frame_no").alias("pair"), F.lit(False).alias("fwd"), (F.col("frame_no") - 1).alias("plane_frame")),
        F.struct((F.col("frame_no") + 1).alias("pair"), F.lit(True).alias("fwd"), (F.col("frame_no") + 1).alias("plane_frame")))
    s = s.select("clip_id", "y", "x", "l", "v", F.explode(ways).alias("w")).select("clip_id", "y", "x", "l", "v", "w.*")
    s = s.join(use, ["clip_id", "pair"], "left_semi").select("clip_id", "plane_frame", "y", "x", "l", "fwd", "v")
    frame = FrameErrors(width, height, sw, sh)
    sums = s.groupBy("clip_id", "plane_frame").cogroup(planes.groupBy("clip_id", "plane_frame")).applyInArrow(
        lambda cells, luma_cells: frame(cells, luma_cells), FrameErrors.schema)
    agg = sums.groupBy("clip_id", "x_slot", "y_slot", "ordinal").agg(
        (F.sum("residual") / F.sum("n")).alias("error"), (F.sum("motion") / F.sum("n")).alias("mean_motion"), big(F.sum("n")).alias("samples"))
    agg = agg.withColumn("error", F.col("error") + F.when(F.col("mean_motion") < 0.025, 0.025).otherwise(0.0))
    grid = candidate_grid(channels, sw, sh).withColumnRenamed("seq_id", "clip_id")
    return grid.join(agg, ["clip_id", "x_slot", "y_slot", "ordinal"])


def rank_motion_candidates(errors: DataFrame) -> DataFrame:
    """Cost, prior and rank of every candidate; costs equal to 1e-7 are ordered by name prior."""
    x, y = F.col("x_channel"), F.col("y_channel")
    d = errors.withColumn("cost", F.col("error") + convention_penalty(
        x, y, F.col("unit"), F.col("forward"), F.col("flip_x"), F.col("flip_y")))
    d = d.withColumn("prior", motion_name_prior(x, "x") + motion_name_prior(y, "y") + F.when(F.col("unit") == "pixels", 5).otherwise(0))
    w = W.partitionBy("clip_id").orderBy(F.round("cost", 7), F.desc("prior"), "x_slot", "y_slot", "ordinal")
    return d.withColumn("rank", F.row_number().over(w))


def calibrate_motion(errors: DataFrame, zero: DataFrame) -> DataFrame:
    """The convention that explains each clip's pairs best, or an inconclusive verdict."""
    top = rank_motion_candidates(errors).where("rank <= 2")
    cols = ["x_channel", "y_channel", "sx", "sy", "flip_x", "flip_y", "forward", "unit", "error", "cost", "mean_motion"]
    best = top.groupBy("clip_id").agg(F.min_by(F.struct(*cols), "rank").alias("b"),
                                      F.max(F.when(F.col("rank") == 2, F.col("cost"))).alias("second")).join(zero, "clip_id")
    b = lambda c: F.col(f"b.{c}")
    z = F.col("zero_error")
    ok = b("error") < z * 0.999
    second = F.coalesce(F.col("second"), F.lit(1.0))
    improvement = clamp01((z - b("error")) / F.greatest(F.lit(1e-5), z))
    separation = clamp01((second - b("cost")) / F.greatest(F.lit(1e-5), second))
    conf = clamp01(0.65 * improvement + 0.25 * separation + 0.10 * clamp01(b("mean_motion") / 2.0))
    when = lambda c: F.when(ok, c)
    return best.select(
        "clip_id", ok.alias("success"), *[when(b(c)).alias(c) for c in cols[:6]],
        when(F.when(b("forward"), "previous_to_current").otherwise("current_to_previous")).alias("direction"),
        when(b("unit")).alias("unit"), b("error").alias("best_error"), z.alias("zero_error"),
        when(conf).alias("confidence"), "sampled_pairs")


def calibrate_motion_sequence(px: DataFrame, chan: DataFrame, channels: DataFrame, width: int, height: int,
                              max_channels: int | None = None, step: int = 1) -> DataFrame:
    """Pairs, candidates, errors and verdict in one plan; inputs at analysis resolution."""
    pairs = informative_pairs(pair_mad(px))
    kept = limit_motion_channels(channels, max_channels)
    errors = motion_candidate_error(px, chan, kept, pairs, width, height, step=step)
    return calibrate_motion(errors, zero_motion_error(px, pairs, step))
