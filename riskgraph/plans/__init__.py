"""Operators put together into complete review runs."""
