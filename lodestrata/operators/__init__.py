"""Operators on DataFrames: reconciliation, retrieval, chunking, evaluation, answers, ingest."""
