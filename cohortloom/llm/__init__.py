"""Operators for training corpora: identification, filtering, deduplication, mixing and tokenization of documents."""
