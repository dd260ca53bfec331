"""Repeated application of a table step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..common import cut_lineage


def iterate_passes(df: DataFrame, step: Callable[[DataFrame], DataFrame], passes: int, checkpoint_every: int = 2) -> DataFrame:
    """Feeds each full result into the next pass; long runs cut their lineage with a checkpoint."""
    if passes < 1:
        raise ValueError("at least one pass")
    for i in range(1, passes + 1):
        df = df.transform(step)
        if i % checkpoint_every == 0 and i < passes:
            df = cut_lineage(df)
    return df
