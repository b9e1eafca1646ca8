"""Operators for preparing training text; nothing else in tidemark imports this subpackage."""
