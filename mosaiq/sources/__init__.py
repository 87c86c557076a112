"""Where documents, queries and stored indexes come from."""
