"""Streaming forms of the batch operators; an extension."""
