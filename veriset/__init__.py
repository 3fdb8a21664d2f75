"""Dataset-integrity audits, leakage-safe splits and classifier evaluation on Spark DataFrames."""
