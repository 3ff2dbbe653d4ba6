"""Structured Streaming: event counts and running state over append-only logs."""
