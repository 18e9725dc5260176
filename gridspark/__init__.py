"""Batch jobs for corpora of text-grid puzzle levels, as PySpark DataFrames."""
