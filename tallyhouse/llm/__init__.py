"""Training-data operators: chat formatting, near-duplicates, quality, packing,
toxicity, page text, decontamination, licences, line rules and language.

Nothing else in the library imports this subpackage; it stays light so that
Python workers can import one operator without loading the others.
"""
