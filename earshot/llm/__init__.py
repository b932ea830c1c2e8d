"""Operators for preparing training text at scale; nothing else in earshot imports this subpackage."""
