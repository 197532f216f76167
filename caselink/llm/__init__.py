"""Operators of a training-data pipeline, as Spark jobs over tables of documents and pages."""
