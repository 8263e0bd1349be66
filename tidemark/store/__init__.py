"""Stored chunks: files, the log of what is stored, and databases that write and read them."""
