"""Operators for training text and training data; nothing outside this subpackage imports it."""
