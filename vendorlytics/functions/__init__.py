"""Column-expression helpers (``expr``)."""
