"""Parsers from landed payloads to one listing schema."""
