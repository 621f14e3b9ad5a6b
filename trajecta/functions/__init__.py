"""Subpackage of trajecta."""
