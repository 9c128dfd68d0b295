"""Corpus operators for training data: mixing, token counts, duplicates, language, quality, licenses, codecs, secrets.

Nothing else in the library imports this subpackage.
"""
