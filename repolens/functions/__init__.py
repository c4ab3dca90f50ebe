"""Column builders and per-file functions."""
