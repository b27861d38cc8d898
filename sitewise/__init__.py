"""sitewise: multi-site data profiling, association screening and data preparation on Spark."""
