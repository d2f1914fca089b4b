"""Dialogue and text analytics as Spark DataFrame plans."""
