"""A Spark engine for multilingual caption and translation corpora."""
