"""Plan helpers: lineage, key hashing, components."""
