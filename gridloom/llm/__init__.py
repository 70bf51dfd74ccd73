"""Training-data operators: formatting, packing, quality, language, deduplication, filters, sharding, mixing.

Nothing outside this folder, ``corpus_pipeline.py`` and the entry module's guarded lookup imports it.
"""
