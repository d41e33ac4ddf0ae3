"""Training-data operators: fingerprints, token output, secret scans, quality rules,
near-duplicates, page text, language, byte-pair encoding, packing and surrogates.

Nothing else in the library imports this subpackage. ``queries`` registers one query
per operator; every other module holds one operator, or helpers they share.
"""
