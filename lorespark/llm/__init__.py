"""Training-data operators: near-duplicates, extraction, tokens, quality, mixing, decontamination."""
