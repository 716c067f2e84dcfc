"""Spatial map analytics on Spark: ordered sequences, entities, geometry, navigation, metadata and results."""

__version__ = "0.1.0"
