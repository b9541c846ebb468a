"""Training-data operators: token counts, packing, scoring, dedup and filters over documents."""
