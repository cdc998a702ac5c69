"""Training-data operators: deduplication, redaction, scoring, tokenisation and decontamination.

Nothing else in the library imports this subpackage.
"""
