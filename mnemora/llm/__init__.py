"""Training-data operators: co-occurrence, near-duplicates, leakage, mixing and residue.

Nothing outside this package imports it.
"""
