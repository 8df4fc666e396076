"""Training-data pipeline operators (mixing, sharding, packing, formatting, filters, deduplication)."""
