"""Silverprint: media-catalog analytics written as Spark DataFrame operators."""
