"""Whole jobs: ingest, and the registered queries over the test tables."""
