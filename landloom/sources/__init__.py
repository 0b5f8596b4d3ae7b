"""Scans, sinks and the tables that queries derive from the test data."""
