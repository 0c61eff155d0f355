"""Set-oriented analytics over a key/value keyspace, on Spark DataFrames."""
