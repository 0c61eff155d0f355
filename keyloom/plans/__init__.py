"""plans of the keyspace engine."""
