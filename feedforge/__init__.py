"""A Spark-first engine for recommendation data, retrieval and offline evaluation."""
