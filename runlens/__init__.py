"""runlens: labelled telemetry experiments as Spark DataFrames."""
