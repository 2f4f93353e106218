"""Column expressions: normalisation, shingles, identifiers and prices."""
