"""Incremental forms of the profile operators."""
