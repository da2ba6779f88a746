"""Subpackage of vectide."""
