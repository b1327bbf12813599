"""Operators over interval, track, transcript and document tables: DataFrames in, DataFrame out."""
