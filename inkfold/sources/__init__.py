"""Scans of quotations, templates, document parts and logs, and the result table."""
