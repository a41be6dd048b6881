"""Readers of collars, intervals and surfaces, and writers of results."""
