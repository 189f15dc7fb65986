"""Training-data operators: sharding, scoring, formatting, joins, mixing, filters, tokenizers."""
