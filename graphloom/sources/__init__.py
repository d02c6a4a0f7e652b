"""Readers and writers of graph files, feeds, logs, transcripts and evaluation sets."""
