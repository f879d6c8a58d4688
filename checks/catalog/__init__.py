"""Importing this package registers every query."""

from checks.catalog import base, directory, imports, players, quality, sheets, standings  # noqa: F401
