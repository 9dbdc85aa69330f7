"""Training-data operators on documents and pages: fingerprints, quality, dedup, mixing, sharding, WARC, token files."""
