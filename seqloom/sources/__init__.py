"""seqloom.sources."""
