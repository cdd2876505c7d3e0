"""Readers and generators of bars, and the tracking store."""
