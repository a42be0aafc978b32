"""Variable selection with false-discovery control, expressed over Spark DataFrames."""
