"""Contrast-pair and steering-vector analytics on Spark."""
