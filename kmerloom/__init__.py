"""kmerloom: sequence and k-mer analytics on Spark DataFrames."""
