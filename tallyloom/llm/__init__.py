"""Operators for building large text corpora: filtering, scoring, de-duplication, packing and storage formats."""
