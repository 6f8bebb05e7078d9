"""Operators of a training-data pipeline over documents, pages and labels; nothing else in the library imports this package."""
