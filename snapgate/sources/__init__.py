"""Snapshot readers: delimited files, JDBC windows, JSON payloads, file inventory."""
