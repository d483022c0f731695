"""Operators of a training-data pipeline. Nothing else in vellum imports this folder."""
