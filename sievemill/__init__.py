"""Research-literature and corpus processing expressed as Spark DataFrames."""
