"""viewflow: named, lazily evaluated relations over Spark DataFrames."""
