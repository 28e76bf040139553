"""tidemark: batch reconciliation of scanned-label words against a reference sheet, on Spark DataFrames."""
