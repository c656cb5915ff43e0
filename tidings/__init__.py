"""Labelled-message analytics on Spark."""
