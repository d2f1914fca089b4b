"""Batch scoring with trained models; training them is outside this engine."""
