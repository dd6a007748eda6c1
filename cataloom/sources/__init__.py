"""Readers and writers of the engine's document shapes."""
