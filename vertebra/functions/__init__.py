"""Column-expression helpers (no UDFs): geometry, time parts, codecs, rounding."""
