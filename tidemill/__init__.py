"""Tabular analytics on Spark: cleaning, joining, profiling, time series, statistics and SQL.

Every operator takes a DataFrame and returns a DataFrame (or a small driver-side
value where the result is a handful of scalars).  See README.md for the map of modules.
"""

__version__ = "0.1.0"
