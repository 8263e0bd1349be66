"""Streams of line protocol into databases."""
