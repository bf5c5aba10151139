"""Column expressions: arrays, scores, hashing and text. No Python runs per row here."""
