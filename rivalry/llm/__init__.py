"""Training-data operators (language ID, quality, dedup, PII, packing, tokenising ...).

Each operator lives in its own module with a general interface; ``queries.py``
holds the thin ``opN_<name>`` digests registered by ``__spark_entry__.py``.
Nothing outside this package imports it.
"""
