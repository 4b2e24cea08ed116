"""Reading landed files and stored tables; upserts, deletes and writes."""
