"""Training-data operators: each takes DataFrames, returns DataFrames and leaves the work to Spark."""
