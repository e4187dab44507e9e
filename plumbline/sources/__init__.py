"""Readers, sinks and file intake."""
