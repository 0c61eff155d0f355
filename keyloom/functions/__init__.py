"""functions of the keyspace engine."""
