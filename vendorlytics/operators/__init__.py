"""Relational patterns with no single Spark call: working days (band join as
prefix counts), conditional distinct counts (no ``Expand``), two-level LOCF,
quantity-limited allocation, month expansion (theta join as explode + equi
join) and positional ``UNION``."""
