"""Streams of rows into tables."""
