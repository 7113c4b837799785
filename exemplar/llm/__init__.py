"""Operators for large training-text corpora (one module per operator) and their registered queries."""
