"""Log analytics on Spark: parse, check, store and search log events."""
