"""Operators over typed-in values, people, addresses and texts. Nothing outside imports this package."""
