"""Readers and writers of ledgers, tables, feeds and stores; bad rows come back with a reason."""
