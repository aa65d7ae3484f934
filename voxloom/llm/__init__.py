"""Operators for preparing training text at scale, each a function from DataFrame to DataFrame."""
