"""Training-data operators: near-duplicate joins, substring dedup, WARC, mixing, secrets, quality, packing, sharding."""
