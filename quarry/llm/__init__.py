"""Training-data operators: tokens, personal data, URLs, duplicates, packing, vectors, secrets, archives, toxicity.

Nothing outside this package imports it.
"""
