"""operators of the keyspace engine."""
