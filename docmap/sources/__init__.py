"""docmap.sources."""
