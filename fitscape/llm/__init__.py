"""Training-data operators: filters, deduplication, scoring, packing. Nothing outside this package imports it."""
