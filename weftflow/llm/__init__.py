"""Operators for preparing training data: scoring, joining, searching, archiving, tokenising and packing of corpora."""
