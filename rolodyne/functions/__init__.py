"""Column functions: text, extraction, similarity, masks, ids."""
