"""Operators for large text, media and embedding corpora. Nothing else in the library imports this subpackage."""
