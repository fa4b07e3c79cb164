"""seqloom.operators."""
