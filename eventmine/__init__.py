"""eventmine: data-mining operators for customer event logs and transactions,
written on Spark DataFrames, Spark ML and Structured Streaming."""

__version__ = "0.1.0"
