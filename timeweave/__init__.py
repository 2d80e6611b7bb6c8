"""timeweave: timed-evidence analytics over DataFrames, SQL and Structured Streaming."""
