"""Readers and writers of the listening data's file formats."""
