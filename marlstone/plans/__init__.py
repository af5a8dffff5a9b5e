"""Planning: fusion of signals, build decisions, command line."""
