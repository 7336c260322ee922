"""Readers for vocabularies, task lists and request rows."""
