"""A strictly typed relational engine with versioned tables on Spark DataFrames."""
