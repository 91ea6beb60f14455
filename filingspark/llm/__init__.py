"""Training-data operators: mixing, quality, tokenising, near-dedup, archives,
language ID, exact search, PII, chat formatting and license scans.

Nothing outside this subpackage imports it.
"""
