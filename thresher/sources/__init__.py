"""Readers and writers for manifests, annotations, file listings and reports."""
