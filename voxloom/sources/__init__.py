"""Readers and writers for the review, glossary, embedding and result tables."""
