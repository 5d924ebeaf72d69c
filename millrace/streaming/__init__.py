"""Structured Streaming forms of windowing, scoring and silence detection."""
