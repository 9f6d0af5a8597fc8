"""Scans, file listings and sinks."""
