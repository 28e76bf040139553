"""Training-data operators: deduplication, classification, mixing, scans and counts over text corpora.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
