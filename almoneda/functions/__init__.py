"""Subpackage of almoneda."""
