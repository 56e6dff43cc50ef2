"""Registered queries, by area of the engine."""
