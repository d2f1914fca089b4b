"""Operators of dialogue and text analytics."""
