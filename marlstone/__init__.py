"""marlstone: a small SQL store's query and data-processing surface, built on Spark DataFrames."""
