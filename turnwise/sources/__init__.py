"""Sources of dialogue and text analytics."""
