"""Sketch analytics on Spark DataFrames: membership, frequency, cardinality, similarity, stream de-duplication."""
