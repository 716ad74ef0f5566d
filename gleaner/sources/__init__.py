"""Readers and writers with explicit schemas and validity checks."""
