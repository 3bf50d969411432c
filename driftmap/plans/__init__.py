"""Whole fits: from points to layouts."""
