"""Readers (JSON, CSV, path columns), sinks (CSV, JSON lines, JSON-array files), dimensions."""
