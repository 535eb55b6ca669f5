"""Readers and writers of reads."""
