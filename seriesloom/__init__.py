"""Spark jobs that turn collections of time series into captioned, checked records."""
