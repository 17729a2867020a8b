"""Training-data operators: mixing, decontamination, quality, duplicates, language, toxicity and sharding."""
