"""Readers, writers and the working folder."""
