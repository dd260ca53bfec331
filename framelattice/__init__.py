"""Frame, motion and guidance analytics over dense per-frame fields, as Spark DataFrames."""
