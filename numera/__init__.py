"""Labelled numerical analytics on Spark."""
