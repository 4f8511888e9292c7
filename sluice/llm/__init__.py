"""Training-data operators: search, extraction, packing, privacy, scoring and de-duplication.

Nothing else in the library imports this subpackage.
"""
