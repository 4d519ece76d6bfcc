"""Named queries with their SQL, by family."""
