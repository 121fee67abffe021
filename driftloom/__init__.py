"""Spark-native engine for simulated detector events: point clouds, genealogies, readout and training data."""

__version__ = "0.1.0"
