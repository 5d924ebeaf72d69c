"""Column-level helpers: time, hashing, units, arrays."""
