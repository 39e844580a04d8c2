"""Spark jobs for building and running a large notice board.

Every job takes DataFrames and returns DataFrames.  Timestamps are
`TIMESTAMP_NTZ` holding UTC wall time, and `now` is always a parameter.
"""
