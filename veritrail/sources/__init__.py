"""Readers: test tables, JSON artifacts, scanner outputs and file trees."""
