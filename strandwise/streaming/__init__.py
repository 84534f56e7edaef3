"""Structured Streaming: live edit logs."""
