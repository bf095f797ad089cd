"""Property-graph, retrieval and text analytics as plain Spark DataFrames."""
