"""Structured Streaming sources, sinks and the streaming redactor."""
