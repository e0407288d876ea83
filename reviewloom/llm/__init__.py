"""Operators over the texts of a training corpus."""
