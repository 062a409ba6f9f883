"""Record linkage and text processing on Spark DataFrames."""
