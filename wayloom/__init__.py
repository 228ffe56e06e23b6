"""Public-transport analytics and training-data operators as Spark DataFrame pipelines."""
