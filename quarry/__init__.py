"""Quarry: retrieval, context assembly and corpus preparation as Spark DataFrames."""
