"""DataFrame operators of the organisational graph."""
