"""Operators for preparing training text: near and exact dedup, surrogates, language, quality, toxicity, licences,
decontamination, id files and packing. Nothing else in the library imports this subpackage."""
