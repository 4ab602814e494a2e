"""Missive: message-archive analytics on Spark DataFrames."""
