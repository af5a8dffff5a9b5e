"""Signal expressions and column functions."""
