"""Stateful streaming gates."""
