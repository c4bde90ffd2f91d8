"""Operators of a training-data pipeline over document tables.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries. Nothing outside this subpackage imports it.
"""
