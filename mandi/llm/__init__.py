"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage.  Each module is one operator:

1 minhash, 2 chat, 3 secrets, 4 packing, 5 langid, 6 mixing, 7 substring, 8 licenses,
9 quality, 10 fingerprint.  ``queries`` registers them as thin ``opN_<name>`` queries.
"""
