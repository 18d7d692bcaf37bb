"""Referential-edit evaluation analytics and training-data operators on Spark."""
