"""Forecast verification and causal feature building on Spark DataFrames."""
