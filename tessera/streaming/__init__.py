"""Corpora that grow."""
