"""Operators from DataFrame to DataFrame, each usable by itself."""
