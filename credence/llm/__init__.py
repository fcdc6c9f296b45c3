"""Operators for preparing training text: search, scoring, near duplicates, extraction, tokens, packing, licences.

Nothing else in the library imports this subpackage.
"""
