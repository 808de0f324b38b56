"""Training-data operators: near-dedup, WARC, sharding, chat, quality, BPE, token files, toxicity, decontamination, substring dedup."""
