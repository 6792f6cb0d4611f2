"""Named queries and whole analyses."""
