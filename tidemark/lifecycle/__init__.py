"""When data is merged, persisted and given up."""
