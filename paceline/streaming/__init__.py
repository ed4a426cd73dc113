"""Operators on activity that arrives as a stream."""
