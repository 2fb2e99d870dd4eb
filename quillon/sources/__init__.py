"""Readers and writers: catalogs, dataset records, predictions, and the adapter for the test tables."""
