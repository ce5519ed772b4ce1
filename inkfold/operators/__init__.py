"""Operators over frames of requests, records, runs, segments and log lines."""
