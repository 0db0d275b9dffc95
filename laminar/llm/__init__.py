"""Corpus preparation operators: filtering, deduplication, search, mixing and packing."""
