"""Training-data operators: language, quality, duplicates, privacy, packing, tokens, licences, archives, vectors."""
