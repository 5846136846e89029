"""Operators of the linkage pipeline, from candidate routes to metrics and checks."""
