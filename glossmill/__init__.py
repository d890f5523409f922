"""Multilingual text and document processing on Spark DataFrames."""
