"""Operators for preparing training text: packing, search, filters, deduplication, rendering and archives.

Nothing else in the library imports this subpackage.
"""
