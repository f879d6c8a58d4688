"""Transforms over checked league tables."""
