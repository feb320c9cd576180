"""Readers and sinks of the benchmark's files."""
