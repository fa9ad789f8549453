"""Where deltas come from and go to: the Parquet log, JSON feeds, rows of relational tables."""
