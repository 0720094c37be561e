"""Station time series on Spark: prepare, forecast, evaluate and compare.

Every public function takes DataFrames and returns a DataFrame, so it can be
used with ``df.transform``.  Time runs in UTC; ``station_id`` names the series.
"""

__version__ = "0.1.0"
