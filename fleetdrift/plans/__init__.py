"""Composite jobs built from the operators."""
