"""Sketch operators over DataFrames: builds are aggregates, probes are column expressions or joins."""
