"""Readers of texts, payloads, session logs and configuration."""
