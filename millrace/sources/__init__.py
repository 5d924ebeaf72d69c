"""Readers, validation gates and writers."""
