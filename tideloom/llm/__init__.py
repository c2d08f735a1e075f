"""Operators of training-data pipelines that the rest of the library doesn't use."""
