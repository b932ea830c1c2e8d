"""The engine's operators, by family; importing this registers their frames and queries."""

from earshot.operators import audit, metrics, prep, profile, sanitize, scorers, training, vectors  # noqa: F401
