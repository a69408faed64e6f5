"""Readers and writers: mappings, OCR words, model answers, redacted PDF files."""
