"""Operators on texts of training corpora. Nothing else in the library imports this."""
