"""Catalogue curation, selection, review and ledger analytics on Spark DataFrames."""
