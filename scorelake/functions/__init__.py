"""Column helpers and skew-proof ordered computations."""
