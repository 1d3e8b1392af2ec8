"""Structured Streaming operators; each shares its transform with a batch twin."""
