"""Readers, writers, merges and extracts."""
