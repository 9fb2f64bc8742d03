"""Constrained-state analytics on Spark: lattices, states, operators and sweeps as DataFrames."""
