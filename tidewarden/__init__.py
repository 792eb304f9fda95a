"""Monitoring analytics on Spark DataFrames: event state, lag, checks, incidents, digests."""
