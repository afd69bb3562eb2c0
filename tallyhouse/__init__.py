"""Counting and segmentation engine on PySpark."""
