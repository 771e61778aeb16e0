"""Find, review and apply changes between two states of data, as Spark DataFrames."""
