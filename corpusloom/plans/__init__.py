"""Whole flows over the operators."""
