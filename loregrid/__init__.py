"""Loregrid: knowledge retrieval and document analytics on Spark DataFrames."""
