"""Find, mask and restore sensitive text in Spark DataFrames and streams."""
