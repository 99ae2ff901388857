"""Whole queries composed from the operators."""
