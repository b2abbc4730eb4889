"""Analytics over structured logs on Spark: ingestion, pages, counts, pre-aggregates, attribute search, retention."""
