"""Audits and jobs: DataFrames in, DataFrames out, nothing collected."""
