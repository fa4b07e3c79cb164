"""seqloom.plans."""
