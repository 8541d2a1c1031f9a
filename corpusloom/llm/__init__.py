"""Operators of a training-data pipeline. Each module holds one, with its query and its SQL."""
