"""seqloom.streaming."""
