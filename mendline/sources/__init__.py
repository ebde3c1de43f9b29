"""Readers of logs, artifacts, SQL, contracts and catalogs; writers of results."""
