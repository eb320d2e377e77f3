"""Operators for preparing training text at scale, their registered queries and their SQL."""
