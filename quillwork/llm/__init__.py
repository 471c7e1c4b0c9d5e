"""Operators for preparing training data. Nothing else in quillwork imports this package."""
