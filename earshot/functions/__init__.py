"""Scalar expressions that differ between SQL dialects."""
