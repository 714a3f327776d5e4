"""Readers and writers with strict contracts."""
