"""Analytics over catalogs of composite items, as Spark jobs."""
