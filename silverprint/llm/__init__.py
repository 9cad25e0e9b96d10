"""Operators of a training-data pipeline: each in a module of its own, their queries in ``queries``."""
