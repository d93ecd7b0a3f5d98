"""docloom: document analytics and training-data operators as plain Spark jobs."""
