"""Readers, writers and the table shapes the operators work on."""
