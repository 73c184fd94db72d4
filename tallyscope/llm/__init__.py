"""Operators that prepare a text corpus: screening, deduplication, decontamination, search and encoding."""
