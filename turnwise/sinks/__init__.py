"""Outputs: pairs, vocabularies, encoded shards, corpus tools' files, run records."""
