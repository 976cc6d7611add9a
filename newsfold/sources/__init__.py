"""Readers of article, price and table sources, and keyed sinks."""
