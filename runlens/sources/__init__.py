"""Readers and writers of raw files and stored tables."""
