"""seqloom.functions."""
