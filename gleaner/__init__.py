"""Content analytics on PySpark: incremental collection, keyed state, notes, statistics and digests."""
