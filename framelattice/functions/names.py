"""Scores and rules over channel names such as ``ViewLayer.Depth.Z``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf(channel: Column) -> Column:
    return F.substring_index(F.lower(channel), ".", -1)


def _has(channel: Column, word: str) -> Column:
    return F.lower(channel).contains(word)


def is_motion_name(channel: Column) -> Column:
    return _has(channel, "vector") | _has(channel, "flow") | _has(channel, "motion")


def depth_name_prior(channel: Column) -> Column:
    lf = leaf(channel)
    return (
        F.when(_has(channel, "depth"), 5.0).otherwise(0.0)
        + F.when(lf == "z", 5.0).otherwise(0.0)
        + F.when(lf == "r", 1.8).when(lf == "g", 1.4).when(lf == "b", 1.0).otherwise(0.0)
        - F.when(lf.isin("a", "alpha"), 8.0).otherwise(0.0)
        - F.when(is_motion_name(channel), 4.0).otherwise(0.0)
    )


def motion_name_prior(channel: Column, axis: str) -> Column:
    lf = leaf(channel)
    wanted = ("x", "r") if axis == "x" else ("y", "g")
    return (
        F.when(is_motion_name(channel), 20).otherwise(0)
        + F.when(lf.isin(*wanted), 10).otherwise(0)
        - F.when(lf.isin("a", "alpha"), 8).otherwise(0)
    )


def _axis_penalty(channel: Column, axis: str) -> Column:
    lf = leaf(channel)
    right, swapped = (("x", "r"), ("y", "g")) if axis == "x" else (("y", "g"), ("x", "r"))
    p = (
        F.when(lf.isin(*right), 0.0).when(lf.isin(*swapped), 0.020).when(lf.isin("z", "b"), 0.035)
        .when(lf.isin("w", "a", "alpha"), 0.070).otherwise(0.025)
    )
    return F.when(is_motion_name(channel), p * 0.35).otherwise(p)


def convention_penalty(x: Column, y: Column, unit: Column, forward: Column, flip_x: Column, flip_y: Column) -> Column:
    """Cost of an unusual interpretation, added to its measured error."""
    return (
        _axis_penalty(x, "x") + _axis_penalty(y, "y")
        + F.when(unit != "pixels", 0.002).otherwise(0.0)
        + F.when(forward, 0.006).otherwise(0.0)
        + F.when(flip_x, 0.0002).otherwise(0.0)
        + F.when(flip_y, 0.0002).otherwise(0.0)
    )


def _ends(channel: Column, suffix: str) -> Column:
    return F.lower(channel).endswith(suffix)


def _bare_or_leaf(channel: Column, name: str) -> Column:
    return (channel == name) | _ends(channel, "." + name.lower())


def channel_rule_rank(channel: Column, role: str) -> Column:
    """Number of the first selection rule the name meets (1 is best), null when it meets none."""
    if role == "depth":
        rules = [
            _ends(channel, ".depth.z"),
            _ends(channel, ".z") & _has(channel, "depth"),
            _has(channel, "depth"),
            _bare_or_leaf(channel, "Z"),
            _bare_or_leaf(channel, "R"),
            _bare_or_leaf(channel, "G"),
            _bare_or_leaf(channel, "B"),
            ~_bare_or_leaf(channel, "A"),
            F.lit(True),
        ]
    else:
        axis, colour = ("X", "R") if role == "motion_x" else ("Y", "G")
        rules = [
            _ends(channel, f".vector.{axis.lower()}"),
            _has(channel, "vector") & _ends(channel, f".{axis.lower()}"),
            is_motion_name(channel) & _ends(channel, f".{colour.lower()}"),
            _bare_or_leaf(channel, axis),
            _bare_or_leaf(channel, colour),
        ]
    out = F.when(rules[0], 1)
    for i, rule in enumerate(rules[1:], start=2):
        out = out.when(rule, i)
    return out
