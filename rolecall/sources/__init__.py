"""Readers that turn landed payloads into raw postings."""
