"""streaming of the keyspace engine."""
