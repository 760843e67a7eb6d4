"""Readers and writers of the engine's record files."""
