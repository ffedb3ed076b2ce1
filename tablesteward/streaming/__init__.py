"""Incremental versions of the session-log operators."""
