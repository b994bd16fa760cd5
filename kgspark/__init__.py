"""kgspark: property-graph analytics and training-data operators as Spark DataFrame jobs."""
