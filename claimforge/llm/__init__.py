"""Operators of a large training-data pipeline: packing, URL rules, decontamination, id files,
similarity joins, repeated passages, token counts, quality, sanitising, toxicity."""
