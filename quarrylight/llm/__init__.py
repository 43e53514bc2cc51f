"""Operators for training data: near-duplicates, splitting, main content, leakage, mixing, personal data."""
