"""Colour, tone, depth and motion display functions. Columns in, columns out; no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..common import as_col, clamp, clamp01, finite, hypot

# Luma weights of the analysed signal.
LUMA = (0.2126, 0.7152, 0.0722)
PI = math.pi


def luma(r: Column, g: Column, b: Column) -> Column:
    """Luma on the input's own scale (0..255 for 8-bit channels)."""
    # Integer weights keep 8-bit input exact until the single division.
    return (r * 2126 + g * 7152 + b * 722) / F.lit(10000.0)


def luma8(r: Column, g: Column, b: Column) -> Column:
    """Luma rounded half away from zero to 0..255."""
    return F.least(F.round(luma(r, g, b)), F.lit(255.0)).cast("int")


def rgb_to_ycocg(r: Column, g: Column, b: Column) -> Column:
    return F.struct(
        (0.25 * r + 0.5 * g + 0.25 * b).alias("y"),
        (0.5 * r - 0.5 * b).alias("co"),
        (-0.25 * r + 0.5 * g - 0.25 * b).alias("cg"),
    )


def ycocg_to_rgb(y: Column, co: Column, cg: Column) -> Column:
    return F.struct((y + co - cg).alias("r"), (y + cg).alias("g"), (y - co - cg).alias("b"))


def quantise8(v: Column) -> Column:
    return F.round(clamp01(v) * 255.0).cast("int")


def tone_map(v: Column, exposure_ev: float = 0.0, mode: str = "aces", srgb: bool = True) -> Column:
    """Linear radiance to a 0..255 display value; mode is clamp, reinhard or aces."""
    x = F.greatest(v * F.lit(2.0 ** exposure_ev), F.lit(0.0))
    if mode == "clamp":
        t = clamp01(x)
    elif mode == "reinhard":
        t = x / (1.0 + x)
    elif mode == "aces":
        t = clamp01((x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14))
    else:
        raise ValueError(f"unknown tone map {mode!r}")
    if srgb:
        c = clamp01(t)
        t = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1.0 / 2.4)) - 0.055)
    return quantise8(t)


def select_channel(r: Column, g: Column, b: Column, a: Column, channel: str) -> Column:
    """One of R, G, B, A or luminance."""
    if channel == "luminance":
        return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]
    return {"r": r, "g": g, "b": b, "a": a}[channel.lower()]


def affine_clamp(v: Column, scale=1.0, offset=0.0) -> Column:
    return clamp01(v * as_col(scale) + as_col(offset))


def map_depth(v: Column, mapping: str, near=0.0, far=1.0, inverted: bool = False) -> Column:
    """raw01 clamps finite values; fixed_range maps [near, far] to [0, 1] with far for non-finite."""
    if mapping == "raw01":
        return F.when(finite(v), clamp01(v)).otherwise(F.lit(0.0))
    if mapping != "fixed_range":
        raise ValueError(f"unknown depth mapping {mapping!r}")
    near, far = as_col(near), as_col(far)
    t = F.when(finite(v), clamp01((v - near) / (far - near))).otherwise(F.lit(1.0))
    return 1.0 - t if inverted else t


def import_motion(x: Column, y: Column, scale_x=1.0, scale_y=1.0, flip_x=False, flip_y=False) -> Column:
    """Scaled and flipped vector; a non-finite component voids the vector (zero, invalid)."""
    vx = x * as_col(-scale_x if flip_x else scale_x)
    vy = y * as_col(-scale_y if flip_y else scale_y)
    ok = finite(vx) & finite(vy)
    return F.struct(F.when(ok, vx).otherwise(0.0).alias("vx"), F.when(ok, vy).otherwise(0.0).alias("vy"),
                    ok.alias("valid"))


def decode_fixed(v: Column) -> Column:
    """Signed S10.5 fixed point to pixels."""
    return v / F.lit(32.0)


def cost01(v: Column) -> Column:
    return v / F.lit(255.0)


def motion_hsv(vx: Column, vy: Column, display_scale: Column) -> Column:
    """Direction as hue, root-compressed magnitude as value; 8-bit r, g, b struct."""
    ok = finite(vx) & finite(vy)
    x, y = F.when(ok, vx).otherwise(0.0), F.when(ok, vy).otherwise(0.0)
    value = F.sqrt(clamp01(hypot(x, y) / display_scale))
    hue = (F.atan2(y, x) + PI) / (2.0 * PI)
    hh = (hue - F.floor(hue)) * 6.0
    sector = F.floor(hh) % 6
    f = hh - F.floor(hh)
    rise, fall, zero = value * f, value * (1.0 - f), F.lit(0.0)

    def pick(*six: Column) -> Column:
        out = F.when(sector == 0, six[0])
        for i in range(1, 5):
            out = out.when(sector == i, six[i])
        return F.when(value > 0.005, quantise8(out.otherwise(six[5]))).otherwise(F.lit(0))

    return F.struct(
        pick(value, fall, zero, zero, rise, value).alias("r"),
        pick(rise, value, value, fall, zero, zero).alias("g"),
        pick(zero, zero, rise, value, value, fall).alias("b"),
    )


def depth_gray(d: Column) -> Column:
    return F.when(finite(d), quantise8(d)).otherwise(F.lit(0))


def softmax_scale_uncertainty(info: Column, var_min: float = 0.0, var_max: float = 10.0,
                              sensitivity: float = 1.0) -> Column:
    """Expected log-scale of a two-component mixture [w0, w1, s0, s1] as an 8-bit uncertainty."""
    w0, w1, s0, s1 = (F.get(info, F.lit(i)) for i in range(4))
    m = F.greatest(w0, w1)
    e0, e1 = F.exp(w0 - m), F.exp(w1 - m)
    expected = (clamp(s0, 0.0, var_max) * e0 + clamp(s1, var_min, 0.0) * e1) / (e0 + e1)
    s = max(0.25, min(2.5, float(sensitivity)))
    u = 1.0 - F.exp(-(F.greatest(expected, F.lit(0.0)) / max(1.0, var_max * 0.45)) * s)
    return F.floor(clamp(u * 255.0, 0.0, 255.0)).cast("int")


def uncertainty_to_reliability(u: Column, trust: float, vx: Column, vy: Column, x: Column, y: Column,
                               width, height) -> Column:
    """Confidence, visibility and disocclusion of a vector from one uncertainty value."""
    u = clamp01(u)
    px, py = x + vx, y + vy
    outside = (px < 0.0) | (py < 0.0) | (px > as_col(width) - 1) | (py > as_col(height) - 1)
    conf = clamp((1.0 - 0.88 * u) * max(0.5, min(1.5, trust)), 0.04, 1.0)
    return F.struct(
        F.when(outside, F.least(conf, F.lit(0.05))).otherwise(conf).alias("confidence"),
        F.when(outside, 0.0).otherwise(clamp01(1.0 - 0.82 * u)).alias("visibility"),
        F.when(outside, 1.0).otherwise(0.0).alias("disocclusion"),
        u.alias("uncertainty"),
    )
