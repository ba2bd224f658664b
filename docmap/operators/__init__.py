"""docmap.operators."""
