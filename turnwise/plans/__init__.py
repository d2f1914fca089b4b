"""Plans of dialogue and text analytics."""
