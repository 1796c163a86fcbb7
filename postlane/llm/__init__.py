"""Operators that turn a mail corpus into training text."""
