"""vecloom: vector search and versioned vector analytics as Spark DataFrames."""
