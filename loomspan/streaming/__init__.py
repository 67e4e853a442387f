"""Structured Streaming forms of the segmentation and tracking operators."""
