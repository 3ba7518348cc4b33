"""Scans of captions, logs and records, and sinks."""
