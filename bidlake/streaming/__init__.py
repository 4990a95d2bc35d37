"""Structured Streaming jobs (real-time pricing)."""
