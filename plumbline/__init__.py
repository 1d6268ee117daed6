"""Data quality on Spark DataFrames: profile, recommend, check, review, score."""
