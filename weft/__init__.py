"""weft: text retrieval and keyed data processing on Spark DataFrames."""
