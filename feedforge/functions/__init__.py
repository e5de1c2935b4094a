"""Column functions; each takes and returns a Column."""
