"""Entity-name resolution and data-set building on Spark DataFrames."""
