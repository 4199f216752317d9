"""docloom: document analytics as Spark DataFrame jobs."""
