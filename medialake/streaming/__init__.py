"""Structured Streaming jobs that follow folder changes and plays."""
