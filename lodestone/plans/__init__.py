"""Registered queries. Importing this package registers all of them."""

from . import extended, graphs, measures, scans, tables  # noqa: F401
