"""Structured Streaming forms of the triage."""
