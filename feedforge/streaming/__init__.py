"""Running versions of the batch operators on event streams."""
