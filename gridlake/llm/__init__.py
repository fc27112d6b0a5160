"""Training-data operators: language id, WARC archives, quality, BPE, dedup, packing, media, counts, PII.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries.
"""
