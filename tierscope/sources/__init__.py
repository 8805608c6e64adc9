"""Readers, writers, providers and the artifact store."""
