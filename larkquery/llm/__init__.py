"""Training-data operators: deduplication, tokenisation, scoring, mixing, formatting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
