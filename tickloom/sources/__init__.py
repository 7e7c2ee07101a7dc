"""Adapters from stored tables to the tick schemas."""
