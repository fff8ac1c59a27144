"""Column-level helpers: time keys, display text, numerics, text parsing."""
