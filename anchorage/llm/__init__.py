"""Operators of a training-data pipeline, over the tables documents and conversations."""
