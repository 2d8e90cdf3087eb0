"""Streams of task records."""
