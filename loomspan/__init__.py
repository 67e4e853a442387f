"""Spark-native analytics over per-frame detections, tracks and call logs."""

__version__ = "0.1.0"
