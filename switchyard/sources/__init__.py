"""Verified scans, loaders and sinks."""
