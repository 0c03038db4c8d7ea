"""Scans of note folders and derived tables, configuration, and model providers."""
