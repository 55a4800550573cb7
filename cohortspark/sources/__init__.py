"""Readers, writers, catalog helpers and load manifests."""
