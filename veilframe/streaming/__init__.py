"""Restoring server-sent events while they arrive."""
