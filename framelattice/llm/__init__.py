"""Operators for training-data pipelines: joins, mixing, packing, formatting, scans, scores and sketches."""
