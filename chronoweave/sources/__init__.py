"""Readers and writers of edge streams and run logs, and tables in shared storage."""
