"""pathloom: learning-path analytics and training-data operators as Spark jobs."""
