"""Appending to an index from a stream."""
