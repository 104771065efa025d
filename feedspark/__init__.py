"""feedspark: ingest, validate and query transit-feed archives and trip documents with Spark."""
