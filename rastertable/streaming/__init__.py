"""Structured Streaming forms of the status flow."""
