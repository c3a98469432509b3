"""Column expressions: geometry, style, numbering, fuzzy text, encodings."""
