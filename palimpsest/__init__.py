"""Revision analytics for text-bearing documents, expressed as Spark DataFrame transformations."""
