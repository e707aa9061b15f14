"""Scans, extraction, the processed store and result sinks."""
