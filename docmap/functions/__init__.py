"""docmap.functions."""
