"""Training-data operators: pseudonyms, page text, source mixing, byte-level
BPE, language, toxicity, licences, and exact, near and embedding duplicates.

Nothing outside this package imports it. ``queries`` holds the thin queries.
"""
