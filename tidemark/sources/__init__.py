"""Readers, the corpus registry and writers."""
