"""Where tables lie: the session's shared folder, versioned tables, and layouts for lookups by id."""
