"""Knowledge-graph construction, graph traversal and hybrid retrieval on Spark DataFrames."""
