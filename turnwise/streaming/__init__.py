"""Streaming of dialogue and text analytics."""
