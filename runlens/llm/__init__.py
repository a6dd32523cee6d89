"""Operators for preparing training text, each on its own over documents or pages."""
