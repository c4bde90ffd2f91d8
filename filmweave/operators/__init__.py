"""Operators over pages, records and graphs."""
