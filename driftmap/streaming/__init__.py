"""Layouts as a stream: steps published to a folder while a fit runs, and read from it."""
