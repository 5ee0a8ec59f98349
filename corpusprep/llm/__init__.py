"""Training-data operators: mixing, quality rules, language identification,
sharding, fingerprints, toxicity, near-duplicates, repeated passages, quality
ranking and tokenising. Nothing outside this subpackage imports it."""
