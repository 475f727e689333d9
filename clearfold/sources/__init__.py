"""Readers and writers of the tables a run uses."""
