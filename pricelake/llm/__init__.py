"""Training-data operators: near-duplicate joins, sharding, span dedup, packing, exact search, quality models,
language-model scoring, byte-level BPE, risk-controlled rules and HTML extraction."""
