"""Joins, selection, aggregation, windows, trajectories, kernels."""
