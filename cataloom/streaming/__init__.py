"""Structured Streaming forms of the engine's running state."""
