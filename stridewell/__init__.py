"""Endurance-training load analytics on Spark DataFrames."""
