"""Readers, writers and the tile registry."""
