"""Forensic-evidence analytics on Spark DataFrames."""
