"""Training-data operators: language, tokens, duplicates, packing, media, privacy, scoring."""
