"""Readers, writers and saved model bundles."""
