"""Batch operators over ticks: each takes and returns DataFrames, with arrival_seq as the only order."""
