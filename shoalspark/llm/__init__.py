"""Training-data operators: media, quality, tokens, language, HTML, packing, mixing, WARC, sharding, near-duplicates.

Nothing outside this folder (but for the guarded import in ``__spark_entry__``
and ``corpus_pipeline``) imports it.
"""
