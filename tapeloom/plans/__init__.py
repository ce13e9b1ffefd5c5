"""Composed jobs: DataFrames in, lake tables out."""
