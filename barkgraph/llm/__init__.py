"""Operators for large text and media corpora. Nothing else in the library imports this subpackage."""
