"""Operators of a training-data pipeline on Spark tables of documents, pages and vectors."""
