"""Readers, writers and generators of points and layouts."""
