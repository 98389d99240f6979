"""Training-data operators: scans, filters, near and exact duplicates, decontamination, mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
