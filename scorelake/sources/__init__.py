"""Readers, writers and the note views over the event tables."""
