"""Relational operators on records, k-mers, indices and graphs: DataFrame in, DataFrame out."""
