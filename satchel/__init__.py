"""Personal-data analytics on Spark: typed tables, queries, entity extraction and incremental sync."""
