"""Operators that prepare training text: duplicates, markup, boilerplate, encodings, tokens, leaks.

Nothing outside this subpackage imports it.
"""
