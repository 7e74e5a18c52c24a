"""Training-data operators: quality, dedup, mixing, packing, sharding, secrets, toxicity.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
