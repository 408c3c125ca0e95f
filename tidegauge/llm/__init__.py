"""Training-data operators: archives, quality, dedup, packing, language, tokens, licences."""
