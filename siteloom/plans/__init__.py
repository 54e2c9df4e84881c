"""Plan helpers: lineage cuts, skew handling, guarded broadcasts."""
