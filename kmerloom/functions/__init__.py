"""Scalar functions: alphabets, k-mers, quality scores and record ids, all as Column expressions."""
