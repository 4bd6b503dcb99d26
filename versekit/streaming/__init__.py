"""Structured Streaming jobs for incremental corpus updates."""
