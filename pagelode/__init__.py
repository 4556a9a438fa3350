"""Page-to-listing analytics on Spark: classify fetched pages, extract listings, detect change, audit."""
