"""Operators over text corpora: deduplication, decontamination, filters, packing. See ``queries`` for how they are applied."""
