"""Operators for preparing text and vectors at scale; an optional part that nothing else in the library imports."""
