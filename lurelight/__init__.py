"""Look-alike domain detection and corpus preparation on Spark DataFrames."""
