"""Readers: log lines, raw records, ingest requests, stored logs, dead letters."""
