"""Scans, sinks and reusable written stages."""
