"""Ledgerloom: audits of account statements and training-data operators as PySpark DataFrames."""
