"""Operators for cleaning and tokenizing training text: one module per operator, queries in ``queries``."""
