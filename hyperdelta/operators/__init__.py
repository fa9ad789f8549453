"""Operators over the log: filters, retractions, object views and their resolution, time travel, upkeep, merging."""
