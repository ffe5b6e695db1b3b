"""Column expressions and two-level scans shared by the operators."""
