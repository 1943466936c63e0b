"""Training-data operators: fingerprints, toxicity, sharding, decontamination, mixing, URL filters, substring and near dedup, HTML text."""
