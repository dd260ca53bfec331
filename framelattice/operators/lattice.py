"""Neighbour access, resampling and motion-compensated lookups on dense lattices.

Three access patterns carry everything else in this package:

* ``neighbourhood``: fixed offsets, by lag/lead over rows and then columns. One exchange on the frame
  key serves both windows and no row is multiplied.
* ``attach_planes`` + ``with_position`` / ``at_position``: data-dependent positions. One array per field and frame is
  joined on the frame key and indexed in generated code, so cells never move again however many
  lookups follow. For frames that a task can hold.
* ``sample_row_pairs``: the same lookups for larger frames, as an equi-join on the row below each
  position; the build side is two image rows, whatever the frame height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import KEYS, as_col, big, clamp, finite
from ..sources.fields import long_to_planes

# ---------------------------------------------------------------------------------------------
# fixed offsets


def _edge(lags: list[Column], here: Column, mirror: Column | None) -> Column:
    """Nearest existing neighbour on that side, or the mirrored one, or the cell itself."""
    return F.coalesce(*lags, *([mirror] if mirror is not None else []), here)


def neighbourhood(cells: DataFrame, cols: list[str], distances=(1,), edge: str = "replicate", keys=KEYS,
                  exchange: bool = True) -> DataFrame:
    """Adds ``n_{dy}_{dx}`` structs of ``cols`` for the eight directions at every distance.

    edge: replicate (clamp), reflect (mirror without repeating the border, distance 1) or null.
    exchange=False leaves out the repartitioning where the cells already sit with their frame.
    """
    d = cells.repartition(*keys) if exchange else cells
    along_x = W.partitionBy(*keys, "y").orderBy("x")
    along_y = W.partitionBy(*keys, "x").orderBy("y")
    me = F.struct(*cols)
    names = {0: "_h0"}
    d = d.withColumn("_h0", me)
    for k in distances:
        for sign, fn in ((-1, F.lag), (1, F.lead)):
            names[sign * k] = f"_h{'m' if sign < 0 else 'p'}{k}"
            v = fn("_h0", k).over(along_x)
            if edge == "replicate":
                if k != 1:
                    raise ValueError("replicated edges are defined for distance 1")
                v = F.coalesce(v, F.col("_h0"))
            elif edge == "reflect":
                other = (F.lead if sign < 0 else F.lag)("_h0", k).over(along_x)
                v = F.coalesce(v, other, F.col("_h0"))
            d = d.withColumn(names[sign * k], v)
    for k in distances:
        trio = F.struct(*[F.col(names[dx]).alias(f"c{i}") for i, dx in enumerate((-k, 0, k))])
        for sign, fn in ((-1, F.lag), (1, F.lead)):
            v = fn(trio, k).over(along_y)
            if edge == "replicate":
                v = F.coalesce(v, trio)
            elif edge == "reflect":
                other = (F.lead if sign < 0 else F.lag)(trio, k).over(along_y)
                v = F.coalesce(v, other, trio)
            d = d.withColumn(f"_v{sign * k}".replace("-", "m"), v)
    out = [c for c in cells.columns]
    picks = []
    for k in distances:
        up, down = F.col(f"_vm{k}"), F.col(f"_v{k}")
        for i, dx in enumerate((-k, 0, k)):
            picks.append(up[f"c{i}"].alias(f"n_{-k}_{dx}"))
            if dx:
                picks.append(F.col(names[dx]).alias(f"n_0_{dx}"))
            picks.append(down[f"c{i}"].alias(f"n_{k}_{dx}"))
    return d.select(*out, *picks)


def nine(col: str) -> list[tuple[int, int, Column]]:
    """(dy, dx, value) of a 3x3 neighbourhood in scan order, the centre included."""
    return [(dy, dx, F.col(col) if (dy, dx) == (0, 0) else F.col(f"n_{dy}_{dx}")[col])
            for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def drop_neighbours(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("n_")])


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def neighborhood_stats(cells: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """3x3 minimum, maximum, mean and variance with clamped edges."""
    d = neighbourhood(cells, [value], keys=keys)
    v = [c for _, _, c in nine(value)]
    mean = _sum(v) / 9.0
    d = d.select(*cells.columns, F.least(*v).alias("local_min"), F.greatest(*v).alias("local_max"),
                 mean.alias("local_mean"), (_sum([c * c for c in v]) / 9.0).alias("_sq"))
    return d.withColumn("local_var", F.greatest(F.lit(0.0), F.col("_sq") - F.col("local_mean") * F.col("local_mean"))).drop("_sq")


# Spatial weights of the edge-aware 3x3 mean (centre, edge, corner).
EDGE_WEIGHTS = (1.0, 0.72, 0.52)


def edge_aware_mean(cells: DataFrame, guide: str, values: list[str], strength: float, keys=KEYS) -> DataFrame:
    """3x3 mean of ``values`` weighted by position and by similarity of ``guide``."""
    sigma = max(0.004, 0.018 + 0.085 * strength)
    d = neighbourhood(cells, [guide, *values], keys=keys)
    w = [(F.exp(-F.abs(c - F.col(guide)) / sigma)) * EDGE_WEIGHTS[abs(dy) + abs(dx)] for dy, dx, c in nine(guide)]
    d = d.withColumn("_w", F.array(*w))
    ws = [F.col("_w")[i] for i in range(9)]
    means = [(_sum([wi * c for wi, (_, _, c) in zip(ws, nine(v))]) / _sum(ws)).alias(f"{v}_mean") for v in values]
    return d.select(*cells.columns, *means)


def median3x3(cells: DataFrame, values: list[str], keys=KEYS) -> DataFrame:
    """Component medians over 3x3 with replicated edges, as ``<value>_med``."""
    d = neighbourhood(cells, values, keys=keys)
    return d.select(*cells.columns, *[
        F.get(F.array_sort(F.array(*[c for _, _, c in nine(v)])), F.lit(4)).alias(f"{v}_med") for v in values])


def gauss3x3(cells: DataFrame, value: str, keys=KEYS, name: str | None = None, exchange: bool = True) -> DataFrame:
    """[1 2 1] x [1 2 1] / 16 blur with mirrored borders."""
    d = neighbourhood(cells, [value], edge="reflect", keys=keys, exchange=exchange)
    blur = _sum([c * ((2 - abs(dy)) * (2 - abs(dx)) / 16.0) for dy, dx, c in nine(value)])
    return d.select(*cells.columns, blur.alias(name or f"{value}_blur"))


# Five-tap binomial kernel.
BINOMIAL5 = (1, 4, 6, 4, 1)


def _decimate(d: DataFrame, cols: list[str], part: list[str], axis: str) -> DataFrame:
    w = W.partitionBy(*part).orderBy(axis)
    rest = [c for c in part if c not in cols]
    taps = []
    for c in cols:
        here = F.col(c)
        l1, r1 = F.coalesce(F.lag(c, 1).over(w), here), F.coalesce(F.lead(c, 1).over(w), here)
        l2, r2 = F.coalesce(F.lag(c, 2).over(w), l1), F.coalesce(F.lead(c, 2).over(w), r1)
        taps.append(_sum([v * k for v, k in zip((l2, l1, here, r1, r2), BINOMIAL5)]).alias(c))
    return d.select(*rest, axis, *taps).where(F.col(axis) % 2 == 0).withColumn(axis, F.floor(F.col(axis) / 2).cast("bigint"))


def pyramid_down(cells: DataFrame, cols: list[str], levels: int = 1, keys=KEYS) -> DataFrame:
    """Anti-aliased half-size pyramid level(s) of integer channels; x is decimated before y is filtered."""
    d = cells.select(*keys, "y", "x", *cols).repartition(*keys)
    for _ in range(levels):
        d = _decimate(d, cols, [*keys, "y"], "x")
        d = _decimate(d, cols, [*keys, "x"], "y")
        d = d.select(*keys, "y", "x", *[F.shiftright(F.col(c) + 128, 8).alias(c) for c in cols])
    return d


# ---------------------------------------------------------------------------------------------
# frame pairs


def pair_previous(cells: DataFrame, cols: list[str], keys=KEYS, prefix: str = "prev_") -> DataFrame:
    """Values of the same cell one frame earlier; null for the first frame or after a gap.

    A lag per cell track: one exchange, and a hot clip is spread over its cells.
    """
    clip, frame = keys
    w = W.partitionBy(clip, "y", "x").orderBy(frame)
    d = cells.withColumn("_p", F.lag(F.struct(frame, *cols)).over(w))
    ok = F.col(f"_p.{frame}") == F.col(frame) - 1
    return d.select(*cells.columns, *[F.when(ok, F.col(f"_p.{c}")).alias(prefix + c) for c in cols])


def shift_frames(df: DataFrame, by: int = 1, frame: str = "frame_no") -> DataFrame:
    """Rows re-keyed to the frame that reads them ``by`` frames later."""
    return df.withColumn(frame, F.col(frame) + by)


# ---------------------------------------------------------------------------------------------
# data-dependent positions


def inside(x: Column, y: Column, width, height) -> Column:
    return (x >= 0.0) & (y >= 0.0) & (x <= as_col(width) - 1) & (y <= as_col(height) - 1)


def _blend(a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column) -> Column:
    top = a + (b - a) * tx
    bottom = c + (d - c) * tx
    return top + (bottom - top) * ty


def with_position(df: DataFrame, name: str, x: Column, y: Column, width, height, clamped: bool = True) -> DataFrame:
    """Adds the array position of (x, y) as ``{name}_i`` (top-left index), ``_r``, ``_d`` (steps right
    and down) and the fractions ``_tx``, ``_ty``, for ``at_position``.

    Positions are columns of their own because every plane read at the same place shares them, and
    because repeating them inside each read would push the generated method over the size the JVM
    compiles. ``clamped=False`` is for positions masked by ``inside`` afterwards.
    """
    w, h = as_col(width).cast("int"), as_col(height).cast("int")
    if clamped:
        x, y = clamp(x, 0.0, (w - 1).cast("double")), clamp(y, 0.0, (h - 1).cast("double"))
    d = df.withColumns({f"{name}_tx": x, f"{name}_ty": y})
    cx, cy = F.col(f"{name}_tx"), F.col(f"{name}_ty")
    d = d.withColumns({f"{name}_i": F.floor(cx).cast("int"), f"{name}_d": F.floor(cy).cast("int")})
    x0, y0 = F.col(f"{name}_i"), F.col(f"{name}_d")
    return d.withColumns({
        f"{name}_tx": cx - x0, f"{name}_ty": cy - y0, f"{name}_i": y0 * w + x0,
        f"{name}_r": F.when(x0 < w - 1, 1).otherwise(0), f"{name}_d": F.when(y0 < h - 1, w).otherwise(0)})


def at_position(plane: Column | str, name: str) -> Column:
    """Bilinear value of a row-major array at a position made by ``with_position``."""
    p = F.col(plane) if isinstance(plane, str) else plane
    i, r, d = (F.col(f"{name}_{k}") for k in "ird")
    return _blend(F.get(p, i), F.get(p, i + r), F.get(p, i + d), F.get(p, i + d + r),
                  F.col(f"{name}_tx"), F.col(f"{name}_ty"))


def drop_position(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[f"{n}_{k}" for n in names for k in ("tx", "ty", "i", "r", "d")])


def gather_nearest(plane: Column, x: Column, y: Column, width, height) -> Column:
    w, h = as_col(width), as_col(height)
    ix = clamp(F.round(x), 0.0, (w - 1).cast("double")).cast("int")
    iy = clamp(F.round(y), 0.0, (h - 1).cast("double")).cast("int")
    return F.get(plane, iy * w.cast("int") + ix)


def attach_planes(cells: DataFrame, planes: DataFrame, keys=KEYS, how: str = "left") -> DataFrame:
    """Frame arrays next to every cell of the frame; only element reads may follow before they are dropped."""
    return cells.join(planes, list(keys), how)


def sample_row_pairs(queries: DataFrame, source: DataFrame, values: dict[str, str], x: str, y: str, width, height,
                     keys=KEYS) -> DataFrame:
    """Clamped bilinear lookup as one equi-join on (frame, row); for frames of any size.

    Each source row is packed with the row below it, so a position needs one match instead of four
    and nothing has to be summed back together.
    """
    w, h = as_col(width), as_col(height)
    rows = source.repartition(*keys).groupBy(*keys, "y").agg(
        F.array_sort(F.collect_list(F.struct("x", *values))).alias("_top"))
    rows = rows.withColumn("_bot", F.coalesce(F.lead("_top").over(W.partitionBy(*keys).orderBy("y")), F.col("_top")))
    cx, cy = clamp(F.col(x), 0.0, (w - 1).cast("double")), clamp(F.col(y), 0.0, (h - 1).cast("double"))
    q = queries.withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_row", F.floor("_cy").cast("bigint"))
    j = q.join(rows.withColumnRenamed("y", "_row"), [*keys, "_row"], "left")
    x0 = F.floor("_cx").cast("int")
    x1 = F.least(x0 + 1, (w - 1).cast("int"))
    tx, ty = F.col("_cx") - x0, F.col("_cy") - F.floor("_cy")
    at = lambda arr, i, f: F.get(F.col(arr), i)[f]
    out = [_blend(at("_top", x0, s), at("_top", x1, s), at("_bot", x0, s), at("_bot", x1, s), tx, ty).alias(n)
           for s, n in values.items()]
    return j.select(*queries.columns, *out)


def sample_bilinear(queries: DataFrame, source: DataFrame, values: dict[str, str], x: str, y: str, width, height,
                    border: str = "clamp", keys=KEYS, access: str = "planes") -> DataFrame:
    """Values of ``source`` at the real-valued positions (x, y) of ``queries``.

    values maps source columns to output names. border: clamp, reject (null outside) or flag (clamped
    value plus an ``inside`` column). access: planes (a frame is one row) or rows (pairs of image rows, for frames too
    large for a task); both give the same values.
    """
    if access not in ("planes", "rows"):
        raise ValueError(f"unknown access {access!r}")
    if access == "planes":
        names = {s: f"_plane_{n}" for s, n in values.items()}
        planes = long_to_planes(source.select(*keys, "y", "x", *values), list(values), keys)
        j = attach_planes(with_position(queries, "_q", F.col(x), F.col(y), width, height), planes.withColumnsRenamed(names), keys)
        out = j.select(*queries.columns, *[at_position(names[s], "_q").alias(n) for s, n in values.items()])
    else:
        out = sample_row_pairs(queries, source, values, x, y, width, height, keys)
    if border == "clamp":
        return out
    ok = inside(F.col(x), F.col(y), width, height)
    if border == "flag":
        return out.withColumn("inside", ok)
    if border != "reject":
        raise ValueError(f"unknown border policy {border!r}")
    return out.select(*queries.columns, *[F.when(ok, F.col(n)).alias(n) for n in values.values()])


def warp_lookup(cur: DataFrame, source: DataFrame, values: dict[str, str], width, height, border: str = "reject",
                keys=KEYS, lag: int = 1, access: str = "planes") -> DataFrame:
    """Sample the field ``lag`` frames earlier at the motion-compensated position (x + vx, y + vy)."""
    q = cur.withColumn("_px", F.col("x") + F.col("vx")).withColumn("_py", F.col("y") + F.col("vy"))
    out = sample_bilinear(q, shift_frames(source, lag, keys[1]) if lag else source, values, "_px", "_py",
                          width, height, border, keys, access)
    return out.drop("_px", "_py")


def nearest_lookup(queries: DataFrame, source: DataFrame, values: dict[str, str], x: str, y: str, width, height,
                   border: str = "clamp", keys=KEYS, outside_value=0.0) -> DataFrame:
    """Value of the nearest cell: a plain equi-join on the rounded index."""
    w, h = as_col(width), as_col(height)
    ix = clamp(F.round(F.col(x)), 0.0, (w - 1).cast("double")).cast("bigint")
    iy = clamp(F.round(F.col(y)), 0.0, (h - 1).cast("double")).cast("bigint")
    q = queries.withColumn("_iy", iy).withColumn("_ix", ix)
    s = source.select(*keys, F.col("y").alias("_iy"), F.col("x").alias("_ix"), *[F.col(a).alias(b) for a, b in values.items()])
    j = q.join(s, [*keys, "_iy", "_ix"], "left")
    ok = inside(F.col(x), F.col(y), width, height) if border == "zero" else F.lit(True)
    return j.select(*queries.columns, *[F.when(ok, F.col(n)).otherwise(F.lit(outside_value)).alias(n)
                                        for n in values.values()])


# ---------------------------------------------------------------------------------------------
# regular resampling


def _targets(pos: Column, size_in: Column, size_out: Column) -> Column:
    """Target indices t with floor(t * size_in / size_out) = pos."""
    lo = F.ceil(pos * size_out / size_in).cast("bigint")
    hi = (F.ceil((pos + 1) * size_out / size_in) - 1).cast("bigint")
    return F.when(hi >= lo, F.sequence(lo, hi))


def resample_nearest(cells: DataFrame, width, height, out_width, out_height) -> DataFrame:
    """Target (x, y) takes source floor(x*W/w), floor(y*H/h).

    Written from the source side: each cell knows which targets read it, so there is no join and no
    shuffle, and cells nobody reads are dropped at the scan.
    """
    w, h, ow, oh = as_col(width), as_col(height), as_col(out_width), as_col(out_height)
    d = cells.withColumn("y", F.explode(_targets(F.col("y"), h, oh)))
    return d.withColumn("x", F.explode(_targets(F.col("x"), w, ow)))


def target_grid(frames: DataFrame, width, height, keys=KEYS) -> DataFrame:
    """Every cell of a width x height lattice for each frame row."""
    one = lambda n: F.sequence(F.lit(0).cast("bigint"), (as_col(n) - 1).cast("bigint"))
    return frames.select(*keys, F.explode(one(height)).alias("y")).select("*", F.explode(one(width)).alias("x"))


def resample_bilinear(cells: DataFrame, values: list[str], width: int, height: int, out_width: int, out_height: int,
                      value_scale: dict[str, float] | None = None, keys=KEYS) -> DataFrame:
    """Centre-aligned bilinear resize with clamped edges; image-pixel vectors are scaled, grid vectors not."""
    grid = target_grid(cells.select(*keys).distinct(), out_width, out_height, keys)
    q = grid.withColumn("_sx", (F.col("x") + 0.5) * (width / out_width) - 0.5).withColumn(
        "_sy", (F.col("y") + 0.5) * (height / out_height) - 0.5)
    out = sample_bilinear(q, cells, {v: v for v in values}, "_sx", "_sy", width, height, keys=keys)
    scale = value_scale or {}
    return out.select(*keys, "y", "x", *[(F.col(v) * scale.get(v, 1.0)).alias(v) for v in values])


def lattice_size(width, height, step: int) -> tuple[Column, Column]:
    return F.ceil(as_col(width) / step), F.ceil(as_col(height) / step)


def sample_lattice(cells: DataFrame, width, height, step: int) -> DataFrame:
    """Nearest cells to the lattice points min(size-1, (g+.5)*step-.5), re-keyed to (gy, gx).

    The cell nearest to point g lies in block g, so this is a filter and not a lookup.
    """
    def pick(axis: str, size) -> tuple[Column, Column]:
        g = F.floor(F.col(axis) / step).cast("bigint")
        return g, F.col(axis) == F.least(big(as_col(size) - 1), F.floor((g + 0.5) * step).cast("bigint"))

    gy, oky = pick("y", height)
    gx, okx = pick("x", width)
    rest = [c for c in cells.columns if c not in ("y", "x")]
    keys = [c for c in rest if c in KEYS]
    return cells.where(oky & okx).select(*keys, gy.alias("gy"), gx.alias("gx"), *[c for c in rest if c not in keys])


def spread_correction(cells: DataFrame, delta: DataFrame, width: int, height: int, step: int, keys=KEYS) -> DataFrame:
    """Bilinear spread of a lattice correction (gy, gx, dx, dy, weight) to full-resolution cells.

    Adds dx, dy, weight; they are zero outside the lattice's hull and where weight <= .001.
    """
    gw, gh = -(-width // step), -(-height // step)
    q = cells.withColumn("_gx", (F.col("x") + 0.5) / float(step) - 0.5).withColumn(
        "_gy", (F.col("y") + 0.5) / float(step) - 0.5)
    src = delta.select(*keys, F.col("gy").alias("y"), F.col("gx").alias("x"), "dx", "dy", "weight")
    out = sample_bilinear(q, src, {"dx": "_dx", "dy": "_dy", "weight": "_wt"}, "_gx", "_gy", gw, gh, "flag", keys)
    ok = F.col("inside") & (F.coalesce(F.col("_wt"), F.lit(0.0)) > 0.001)
    return out.select(*cells.columns, *[F.when(ok, F.col(s)).otherwise(0.0).alias(n)
                                        for s, n in (("_dx", "dx"), ("_dy", "dy"), ("_wt", "weight"))])


def landing_coverage(grid_flow: DataFrame, vx: str, vy: str, grid_w: int, grid_h: int, width: int, height: int,
                     name: str = "coverage", keys=KEYS) -> DataFrame:
    """Density of where the grid's vectors land, splatted with bilinear weights.

    Every cell also contributes itself with weight zero, so the result is complete without a join.
    """
    ppx, ppy = width / grid_w, height / grid_h
    dx = (F.col("gx") + 0.5) * ppx - 0.5 + F.col(vx)
    dy = (F.col("gy") + 0.5) * ppy - 0.5 + F.col(vy)
    ok = F.coalesce((dx >= 0) & (dy >= 0) & (dx <= width - 1) & (dy <= height - 1), F.lit(False))
    d = grid_flow.select(*keys, "gy", "gx", ok.alias("_ok"), ((dx + 0.5) / ppx - 0.5).alias("_tx"),
                         ((dy + 0.5) / ppy - 0.5).alias("_ty"))
    x0, y0 = F.floor("_tx"), F.floor("_ty")
    fx, fy = F.col("_tx") - x0, F.col("_ty") - y0
    hits = [F.struct((y0 + oy).alias("gy"), (x0 + ox).alias("gx"),
                     ((fx if ox else 1.0 - fx) * (fy if oy else 1.0 - fy)).alias("w")) for oy in (0, 1) for ox in (0, 1)]
    own = F.struct(F.col("gy").alias("gy"), F.col("gx").alias("gx"), F.lit(0.0).alias("w"))
    splat = d.select(*keys, F.explode(F.when(F.col("_ok"), F.array(own, *hits)).otherwise(F.array(own))).alias("s")).select(*keys, "s.*")
    splat = splat.where((F.col("gx") >= 0) & (F.col("gx") < grid_w) & (F.col("gy") >= 0) & (F.col("gy") < grid_h))
    return splat.groupBy(*keys, "gy", "gx").agg(F.sum("w").alias(name))


def _step_ok(width, height) -> Column:
    return (F.col("valid") & inside(F.col("_px"), F.col("_py"), width, height)
            & finite(F.col("_gx")) & finite(F.col("_gy")))


def invert_flow(forward: DataFrame, width: int, height: int, iterations: int = 4, keys=KEYS,
                targets: DataFrame | None = None, access: str = "planes") -> DataFrame:
    """current->previous vectors of a previous->current field by fixed-point iteration.

    p <- q - F(p), void if a sample leaves the image. The planes are attached once and all
    iterations are column expressions on them, so the plan does not grow with the iterations.
    forward(vx, vy) must already be keyed to the frame that reads it.
    """
    grid = targets if targets is not None else forward.select(*keys, "y", "x")
    if access == "rows":
        return _invert_flow_rows(forward, grid, width, height, iterations, keys)
    planes = long_to_planes(forward.select(*keys, "y", "x", "vx", "vy"), ["vx", "vy"], keys).withColumnsRenamed(
        {"vx": "_fx", "vy": "_fy"})
    d = attach_planes(grid, planes, keys).withColumn("_px", F.col("x").cast("double")).withColumn(
        "_py", F.col("y").cast("double")).withColumn("valid", F.lit(True))
    for _ in range(iterations):
        d = with_position(d, "_q", F.col("_px"), F.col("_py"), width, height)
        d = drop_position(d.withColumns({"_gx": at_position("_fx", "_q"), "_gy": at_position("_fy", "_q")}), "_q")
        d = d.withColumn("valid", _step_ok(width, height))
        d = d.withColumns({"_px": F.when(F.col("valid"), F.col("x") - F.col("_gx")).otherwise(F.col("_px")),
                           "_py": F.when(F.col("valid"), F.col("y") - F.col("_gy")).otherwise(F.col("_py"))})
    return d.select(*grid.columns, F.when(F.col("valid"), F.col("_px") - F.col("x")).alias("vx"),
                    F.when(F.col("valid"), F.col("_py") - F.col("y")).alias("vy"), "valid")


def _invert_flow_rows(forward, grid, width, height, iterations, keys) -> DataFrame:
    d = grid.withColumn("_px", F.col("x").cast("double")).withColumn("_py", F.col("y").cast("double")).withColumn(
        "valid", F.lit(True))
    for _ in range(iterations):
        s = sample_row_pairs(d, forward, {"vx": "_gx", "vy": "_gy"}, "_px", "_py", width, height, keys)
        s = s.withColumn("valid", _step_ok(width, height))
        d = s.select(*grid.columns, "valid", F.when(F.col("valid"), F.col("x") - F.col("_gx")).otherwise(F.col("_px")).alias("_px"),
                     F.when(F.col("valid"), F.col("y") - F.col("_gy")).otherwise(F.col("_py")).alias("_py"))
    return d.select(*grid.columns, F.when(F.col("valid"), F.col("_px") - F.col("x")).alias("vx"),
                    F.when(F.col("valid"), F.col("_py") - F.col("y")).alias("vy"), "valid")
