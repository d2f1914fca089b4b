"""Functions of dialogue and text analytics."""
