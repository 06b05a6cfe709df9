"""Landed source files and the source catalogue."""
