"""Readers, writers and the league derived from the test tables."""
