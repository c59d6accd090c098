"""Clinical cohort analytics on Spark DataFrames."""
