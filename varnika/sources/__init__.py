"""Readers and writers with explicit schemas, and extraction from landed pages."""
