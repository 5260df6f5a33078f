"""Versioned graph-state analytics over an append-only commit log, on PySpark."""
