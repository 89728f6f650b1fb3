"""Operators of a training-data pipeline: search, token files, surrogates, mixing,
deduplication, quality rules, tokenization, chat formatting and licence scans.

Nothing outside this subpackage imports it; ``queries.load_all()`` registers its queries.
"""
