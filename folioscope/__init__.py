"""Documentation corpus engine on Spark DataFrames."""
