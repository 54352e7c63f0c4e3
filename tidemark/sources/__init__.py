"""Readers, views over the star-schema tables, and table sinks."""
