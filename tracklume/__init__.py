"""Tracking analytics on Spark: DataFrame operators, sources, functions, plans and streams."""
