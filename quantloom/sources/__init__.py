"""Readers, panel views and sinks."""
