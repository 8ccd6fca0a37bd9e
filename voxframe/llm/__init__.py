"""Training-data operators: quality, toxicity, sharding, deduplication, fingerprints,
packing, page extraction, tokenizing and secret scans."""
