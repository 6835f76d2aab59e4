"""Operators for preparing training text: quality, duplicates, tokens, language, licences, leaks.

Nothing else in the library imports this subpackage.
"""
