"""Searchable visual content of documents as Spark DataFrames."""
