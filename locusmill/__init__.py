"""Quote location, text alignment and keyed-record operators built on Spark DataFrames."""
