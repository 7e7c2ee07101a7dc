"""Operators over unbounded streams."""
