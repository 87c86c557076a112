"""Execution helpers shared by operators: sessions and intermediate tables."""
