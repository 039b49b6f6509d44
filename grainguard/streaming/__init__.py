"""Structured Streaming forms of the governance and scoring jobs."""
