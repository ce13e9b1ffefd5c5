"""Scans, sinks and feed readers."""
