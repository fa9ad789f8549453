"""Analytics over an append-only log of attributed assertions, on Spark DataFrames."""
