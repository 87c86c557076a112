"""Index building, search, mutation, metadata filters and evaluation as DataFrame operators."""
