"""Data Vault 2.0 on Spark DataFrames: stage, load, read, profile, check, match, extend and score."""
