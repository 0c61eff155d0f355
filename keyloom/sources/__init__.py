"""sources of the keyspace engine."""
