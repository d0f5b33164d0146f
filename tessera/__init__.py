"""Spark-first analytics over event histories, free text and typed graphs."""
