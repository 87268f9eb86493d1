"""Structured Streaming: logs that grow, and event windows."""
