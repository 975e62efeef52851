"""Snapshot landing, quality gates, conformance and profiling on Spark DataFrames."""
