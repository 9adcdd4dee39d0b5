"""Spark-native analytics for seismic picks, events and detections."""

__version__ = "0.1.0"
