"""millrace: tabular machine-learning operators as Spark DataFrame transformations."""
