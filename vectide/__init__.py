"""Analytics over labelled vectors and their distributions, as Spark DataFrame operations."""
