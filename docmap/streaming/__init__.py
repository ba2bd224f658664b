"""docmap.streaming."""
