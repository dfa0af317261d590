"""Spark-first analytics over three-dimensional points."""
