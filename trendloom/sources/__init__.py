"""Scans, sinks and small configuration tables."""
