"""Readers for the tables every query starts from."""

from loomery.sources.tables import table

__all__ = ["table"]
