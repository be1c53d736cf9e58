"""Operators for training data: similar vectors, splitting, batch deduplication, packing, leakage, residue."""
