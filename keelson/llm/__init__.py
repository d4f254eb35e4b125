"""Training-data operators over text, media and archive tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
